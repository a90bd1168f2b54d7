"""Prompt texts as Column templates. The wording is our own; the reply shapes are in ``schemas``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def render(template: str, **values: Column) -> Column:
    """Fill ``{{name}}`` slots of a template with columns."""
    parts: list[Column] = []
    rest = template
    while "{{" in rest:
        before, rest = rest.split("{{", 1)
        name, rest = rest.split("}}", 1)
        parts += [F.lit(before), F.coalesce(values[name.strip()].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


TEMPLATES = {
    "entities": (
        "List the entities that the passage names.\n"
        'Reply with JSON: {"entities": [{"entity_name": "...", "entity_description": "...", "is_named_entity": true}]}\n\n'
        "Passage:\n{{text}}"
    ),
    "missed_entities": (
        "These entities were already found: {{known}}\nList further entities of the passage, or an empty list.\n"
        'Reply with JSON: {"entities": [{"entity_name": "...", "entity_description": "...", "is_named_entity": true}]}\n\n'
        "Passage:\n{{text}}"
    ),
    "more_entities": (
        "These entities were found: {{known}}\nDoes the passage name any other entity? Reply YES or NO.\n\nPassage:\n{{text}}"
    ),
    "relations": (
        "Using only the entities {{names}}, list the relations that the passage states. Strength runs from 1 to 10.\n"
        'Reply with JSON: {"relationships": [{"source_entity": "...", "target_entity": "...", '
        '"relationship_description": "...", "relationship_strength": 5, "relationship_keywords": ["..."]}]}\n\n'
        "Passage:\n{{text}}"
    ),
    "one_pass": (
        "List at most 15 entities and 20 relations of the passage, and keywords for its content.\n"
        'Reply with JSON: {"entities": [], "relationships": [], "content_keywords": []}\n\nPassage:\n{{text}}'
    ),
    "entity_summary": (
        "Write one summary of {{name}} from these notes.\n\nDescriptions:\n{{descriptions}}\n\nRelations:\n{{relations}}"
    ),
    "document_summary": "Summarise the document whose entities are:\n{{entities}}",
    "similarity": (
        "Do both texts describe the same thing? Score 0 to 10.\n"
        'Reply with JSON: {"reasoning": "...", "score": 0}\n\n'
        "1. {{name_1}}: {{summary_1}}\n\n2. {{name_2}}: {{summary_2}}"
    ),
    "question_entities": 'Which entities does the question name? Reply with JSON: {"entities": ["..."]}\n\nQuestion: {{question}}',
    "retrieval_plan": (
        "Choose the documents that must be read in full and, for others, the entities to look up.\n"
        'Reply with JSON: {"reasoning": "...", "main_documents": ["..."], "assist_documents": {"doc": ["entity"]}}\n\n'
        "Question: {{question}}\n\nDocuments:\n{{context}}"
    ),
    "entity_selection": (
        "Which of these entities help with the question? Reply with JSON: "
        '{"selected_entities": ["..."]}\n\nQuestion: {{question}}\nDocument: {{summary}}\nEntities: {{names}}'
    ),
    "synthesis": (
        "Answer from the evidence, or ask one follow-up question.\n"
        'Reply with JSON: {"decision": "ANSWER" or "SUB_QUESTION", "content": "...", "summary": "..."}\n\n'
        "Question: {{question}}\n\nHistory:\n{{history}}\n\nEvidence:\n{{evidence}}"
    ),
}


def entities(text: Column) -> Column:
    return render(TEMPLATES["entities"], text=text)


def missed_entities(text: Column, known: Column) -> Column:
    return render(TEMPLATES["missed_entities"], text=text, known=known)


def relations(text: Column, names: Column) -> Column:
    return render(TEMPLATES["relations"], text=text, names=names)


def more_entities(text: Column, known: Column) -> Column:
    return render(TEMPLATES["more_entities"], text=text, known=known)


def one_pass(text: Column) -> Column:
    return render(TEMPLATES["one_pass"], text=text)
