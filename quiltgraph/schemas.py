"""Explicit schemas of every table the engine reads or writes."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


S, I, D, B = StringType(), IntegerType(), DoubleType(), BooleanType()
STRINGS = ArrayType(S)
VECTOR = ArrayType(DoubleType())

DOCUMENT = _struct(("id", S), ("text", S))
RAW_PAGE = _struct(("query_title", S), ("title", S), ("content", S), ("url", S))
PARAGRAPH = _struct(("id", S), ("text", S))
NESTED_QUESTION = _struct(("id", S), ("question", S), ("answer", S), ("paragraphs", ArrayType(PARAGRAPH)))
QUESTION = _struct(("id", S), ("question", S), ("answer", S), ("ids", STRINGS))
MULTIHOP = _struct(
    ("id", S), ("question", S), ("answer", S), ("type", S),
    ("supporting_facts", _struct(("title", STRINGS))),
    ("context", _struct(("title", STRINGS), ("sentences", ArrayType(STRINGS)))),
)
ANSWER_LOG = _struct(
    ("id", S), ("question", S), ("answer", S), ("ids", STRINGS),
    ("LLM_answer", S), ("LLM_ids", STRINGS), ("duration", D),
)

CHUNK = _struct(("chunk_id", S), ("doc_id", S), ("chunk_order_index", I), ("tokens", I), ("content", S))
FAILED_CHUNK = _struct(("tokens", I), ("content", S), ("chunk_order_index", I), ("chunk_id", S), ("doc_id", S))
ENTITY = _struct(
    ("entity_id", S), ("name", S), ("summary", S), ("type", S), ("doc_id", S), ("is_named_entity", B),
)
RELATION = _struct(
    ("source_entity_id", S), ("target_entity_id", S), ("source_entity_name", S), ("target_entity_name", S),
    ("description", S), ("strength", D), ("keywords", STRINGS), ("doc_id", S),
)
SOURCED_FROM = _struct(("entity_id", S), ("chunk_id", S), ("doc_id", S))
DOCUMENT_NODE = _struct(("doc_id", S), ("summary", S), ("placeholder", B))
SAME_AS = _struct(
    ("entity_1_id", S), ("entity_2_id", S), ("score", D),
    ("created_at", TimestampType()), ("updated_at", TimestampType()),
)
CHUNK_VECTOR = _struct(("chunk_id", S), ("doc_id", S), ("content", S), ("dense_vector", VECTOR))
ENTITY_VECTOR = _struct(
    ("entity_id", S), ("doc_id", S), ("name", S), ("is_named_entity", B), ("description", S), ("dense_vector", VECTOR),
)
SUMMARY_VECTOR = _struct(("doc_id", S), ("summary", S), ("dense_vector", VECTOR))
LINK_DETAIL = _struct(
    ("entity_1_id", S), ("entity_2_id", S), ("entity_1_name", S), ("entity_2_name", S),
    ("llm_score", I), ("llm_reasoning", S), ("embedding_score", D), ("final_score", D), ("is_linked", B),
)

# Shapes of model replies.
ENTITY_REPLY = _struct(
    ("entities", ArrayType(_struct(("entity_name", S), ("entity_description", S), ("is_named_entity", S)))),
)
RELATION_REPLY = _struct(
    ("relationships", ArrayType(_struct(
        ("source_entity", S), ("target_entity", S), ("relationship_description", S),
        ("relationship_strength", D), ("relationship_keywords", STRINGS),
    ))),
)
ONE_PASS_REPLY = _struct(
    ("entities", ENTITY_REPLY["entities"].dataType), ("relationships", RELATION_REPLY["relationships"].dataType), ("content_keywords", STRINGS),
)
NAMES_REPLY = _struct(("entities", STRINGS))
PLAN_REPLY = _struct(("reasoning", S), ("main_documents", STRINGS), ("assist_documents", MapType(S, STRINGS)))
SELECTION_REPLY = _struct(("selected_entities", STRINGS))
DECISION_REPLY = _struct(("decision", S), ("content", S), ("next_question", S), ("summary", S))
