"""Secrets in text: three fixed patterns, and runs of characters that a Markov model takes for random.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from labelled
samples; a run is reported when the mean log-likelihood ratio of its transitions is at least ``ratio``. DataFrame functions
only. One pass over the texts leaves, for documents with any match, the lengths of matches and of the text between them;
places follow as running sums over those few rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltgraph.functions.sizes import cut_lineage, proven_small

# Fixed patterns of the task; the second number is the least length, of group 2 for the first kind.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 8), ("access", ACCESS, 16), ("hex", HEX, 32))
KINDS = ("assign", "access", "hex", "random")
#: Cheap tests that every text with a match of the kind passes.
_MAY = {"assign": "(?i)(?:password|passwd|secret|token|api_?key)", "hex": "[0-9a-f]{32}"}

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
LEAST = 20
RATIO = 1.0
SAMPLE_DOCUMENTS = 4000
BROADCAST_DOCUMENTS = 200_000
MASK = "[SECRET]"
_RUN = "[A-Za-z0-9+/_.=-]{%d,}"


def _transitions(token: Column) -> Column:
    """Numbers of a token's character pairs, in order."""
    n = len(ALPHABET)
    codes = F.filter(F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), lambda c: c >= 0)
    return F.zip_with(
        F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.size(codes)),
        lambda a, b: (a * n + b).cast("int"),
    )


def fit(samples: DataFrame, token: str = "token", random: str = "random", smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each character pair.

    Rows with a null token or label are skipped; characters outside the alphabet are passed over. Pair counts are summed in
    Spark; the driver gets at most two numbers for each of the alphabet's pairs. Without samples every ratio is 0.
    """
    n = len(ALPHABET)
    counts = samples.select(F.col(token).alias("t"), F.col(random).alias("r")).filter("t is not null and r is not null")
    counts = counts.select("r", F.explode(_transitions(F.col("t"))).alias("pair")).groupBy("r", "pair").count()
    seen = {True: [smoothing] * (n * n), False: [smoothing] * (n * n)}
    for row in counts.toLocalIterator():
        seen[bool(row["r"])][row["pair"]] += row["count"]
    logs = {}
    for label, cells in seen.items():
        sums = [sum(cells[i * n : i * n + n]) for i in range(n)]
        logs[label] = [math.log(c / sums[i // n]) for i, c in enumerate(cells)]
    return [a - b for a, b in zip(logs[True], logs[False], strict=True)]


def samples(docs: DataFrame, text: str = "text", key: str = "doc_id", most: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Labelled samples from at most ``most`` documents (those with the smallest hashes of their ids).

    Ordinary: their words of six characters and more that no fixed pattern matches. Random: the values that the patterns
    find there, and digests of the same documents in hexadecimal and base 64.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    ids = docs.filter(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h")).distinct()
    last = ids.orderBy("h").limit(most).agg(F.max("h")).first()[0]  # ids first, so that no texts are moved
    some = docs.select(F.xxhash64(key).alias("h"), body.alias("t"), F.col(key).alias("_k")).filter(
        F.col("_k").isNotNull() & (F.col("h") <= F.lit(last).cast("bigint")))
    digest = F.sha2(F.concat(F.col("h").cast("string"), "t"), 512)
    values = F.filter(
        F.concat(*(F.regexp_extract_all("t", F.lit(p), F.lit(2 if k == "assign" else 0)) for k, p, _ in BASE)),
        lambda v: F.length(v) >= 16,
    )
    positive = some.select(F.explode(F.concat(values, F.array(
        F.substring(digest, 1, 40), F.regexp_replace(F.base64(F.unhex(digest)), "[\r\n]", "")))).alias("token"), F.lit(True).alias("random"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("t"), ASSIGN, " "), ACCESS, " "), "[0-9a-f]{32,}", " ")
    negative = some.select(F.explode(F.regexp_extract_all(rest, F.lit(_RUN % 6), F.lit(0))).alias("token"), F.lit(False).alias("random"))
    return positive.unionByName(negative)


def ratio_of(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's character pairs; 0 for a token without pairs."""
    table = F.split(F.lit(",".join(f"{v:.6f}" for v in model)), ",").cast("array<double>")
    pairs = _transitions(token)
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.get(table, p))
    return F.coalesce(total / F.nullif(F.size(pairs), F.lit(0)), F.lit(0.0))


def _found(text: Column, kind: str, pattern: str, valid, may: Column) -> Column:
    """Struct of the kind, the lengths between matches and, for each match, its length and whether it counts."""
    nothing = "struct<kind:string,parts:array<struct<gap:int,len:int,ok:boolean>>>"
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(gaps, F.transform(hits, lambda h: F.struct(F.length(h).alias("len"), valid(h).alias("ok"))),
                       lambda g, h: F.struct(g.alias("gap"), h["len"].alias("len"), h["ok"].alias("ok")))
    return F.when(may, F.struct(F.lit(kind).alias("kind"), parts.alias("parts"))).otherwise(F.lit(None).cast(nothing))


def spans(docs: DataFrame, model: list[float], text: str = "text", keys: tuple[str, ...] = ("doc_id",), least: int = LEAST,
          ratio: float = RATIO) -> DataFrame:
    """``keys`` and ``spans``: the document's spans as structs (start, kind_no, end), sorted.

    One row per input row, also for repeated ones. A null text is empty and has no spans. Places count code points from 0,
    the end is exclusive. Equal spans of different kinds all stay. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    run = _RUN % least
    value_length = lambda h: F.length(F.regexp_extract(h, ASSIGN, 2))
    found = F.array(
        _found(body, "assign", ASSIGN, lambda h: value_length(h) >= 8, body.rlike(_MAY["assign"])),
        _found(body, "access", ACCESS, lambda h: F.length(h) >= 16, body.contains("AKIA")),
        _found(body, "hex", HEX, lambda h: F.length(h) >= 32, body.rlike(_MAY["hex"])),
        _found(body, "random", run, lambda h: ratio_of(h, model) >= ratio, body.rlike(run[:-2] + "}")),
    )
    kept = F.filter(found, lambda f: f["kind"].isNotNull() & F.exists(f["parts"], lambda p: p["ok"]))
    # The row number is written with the rows, so it is the same for every later reader.
    scanned = cut_lineage(docs.select(*keys, F.monotonically_increasing_id().alias("_row"), kept.alias("_kinds")))
    rows = scanned.filter(F.size("_kinds") > 0).select("_row", F.explode("_kinds").alias("k"))
    rows = rows.select("_row", F.array_position(F.array(*map(F.lit, KINDS)), F.col("k.kind")).alias("kind_no"), F.posexplode("k.parts").alias("at", "p"))
    upto = Window.partitionBy("_row", "kind_no").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.col("p.gap") + F.coalesce("p.len", F.lit(0))).over(upto)
    placed = rows.withColumn("end", ends).filter("p.ok").select("_row", F.struct(
        (F.col("end") - F.col("p.len")).alias("start"), "kind_no", "end").alias("s"))
    gathered = placed.groupBy("_row").agg(F.array_sort(F.collect_list("s")).alias("spans"))  # of one document
    empty = F.array().cast("array<struct<start:bigint,kind_no:bigint,end:bigint>>")
    return scanned.join(gathered, "_row", "left").select(*keys, F.coalesce("spans", empty).alias("spans"))


def digest(found: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of each fixed kind, digest of the fixed kinds' spans, and all spans as text."""
    names = F.array(*map(F.lit, KINDS))
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind_no"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")
    spans_of = F.col("spans")
    number = lambda k: F.size(F.filter(spans_of, lambda s: s["kind_no"] == k + 1)).cast("bigint").alias(f"n_{KINDS[k]}")
    base = F.filter(spans_of, lambda s: s["kind_no"] <= len(BASE))
    return found.select(*keys, *(number(k) for k in range(len(BASE))), F.sha2(written(base), 256).alias("base_sha256"), written(spans_of).alias("spans"))


def redact(docs: DataFrame, model: list[float], text: str = "text", key: str = "doc_id", mask: str = MASK) -> DataFrame:
    """``docs`` with every span, overlapping ones merged, replaced by ``mask``; all columns and rows stay."""
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    docs, text, key = docs.toDF(*plain), plain[names.index(text)], plain[names.index(key)]
    keyed = docs.withColumn("_hash", F.xxhash64(text))
    found = spans(keyed.select(F.col(key).alias("_id"), "_hash", F.col(text).alias("_body")), model, "_body", ("_id", "_hash"))
    found = found.filter(F.size("spans") > 0).dropDuplicates(["_id", "_hash"])
    merged = F.aggregate("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    found = cut_lineage(found.select("_id", F.col("_hash").alias("_h"), merged.alias("_cut")))
    if proven_small(found, BROADCAST_DOCUMENTS):  # else the texts are shuffled to their spans
        found = F.broadcast(found)
    cut = F.col("_cut")
    piece = lambda s, i: F.concat(F.substr(
        F.col(text), F.coalesce(F.get(cut, i - 1)["end"], F.lit(0)).cast("int") + 1,
        (s["start"] - F.coalesce(F.get(cut, i - 1)["end"], F.lit(0))).cast("int")), F.lit(mask))
    masked = F.concat(F.array_join(F.transform(cut, piece), ""), F.substr(F.col(text), F.element_at(cut, -1)["end"].cast("int") + 1))
    joined = keyed.join(found, (F.col(key).eqNullSafe(F.col("_id"))) & (F.col("_hash") == F.col("_h")), "left")
    return joined.withColumn(text, F.when(cut.isNotNull(), masked).otherwise(F.col(text))).select(*plain).toDF(*names)
