"""Secret scanning through a trigram inverted index; DataFrame functions only.

1. Each rule's regex yields a Boolean trigram query (`regex_trigrams`): a disjunction of conjunctions of trigrams.
2. The index is a written table of postings (trigram, text key) over the trigrams that any query names, sorted by
   trigram. A text key is the 64-bit hash of the text, so copies share their postings.
3. Postings are intersected by counting, per text and clause, the clause's trigrams found; a full clause makes the text
   a candidate of the rule. Candidates come back by a join on the key; a colliding key only adds a candidate.
4. The regexes verify the candidates. Rules without mandatory trigrams (`hex`) scan every text.

Matches are leftmost and non-overlapping per rule; those whose group is too short are dropped. Offsets are code points.

Edge cases: null texts count as empty; copies, ties and null doc_ids give one row each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import materialize, read
from lexloom.llm.regex_trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Published token formats, beyond the base.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, list[str]]:
    """(postings of text keys by trigram number, the trigrams by number)."""
    named = sorted({t for r in rules for clause in trigram_query(r.pattern) or () for t in clause})
    low = F.col("_low")
    # a generator of one row: else the optimizer would lower-case the text once for each trigram
    texts = docs.select(F.inline(F.array(F.struct(F.coalesce("text", F.lit("")).alias("_text"), F.lower(F.coalesce("text", F.lit(""))).alias("_low")))))
    rows = texts.select(
        F.xxhash64("_text").alias("_key"),
        F.array_compact(F.array(*(F.when(low.contains(t), F.lit(i)) for i, t in enumerate(named)), F.lit(None).cast("int"))).alias("_ts"),
    )
    postings = rows.select("_key", F.explode("_ts").alias("_t")).distinct().sortWithinPartitions("_t", "_key")
    return materialize(postings, "postings"), named


def candidates(postings: DataFrame, named: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Texts that satisfy some rule's query: _key and _rules, an array of rule numbers."""
    number = {t: i for i, t in enumerate(named)}
    terms = [
        (r, c, number[t], len(clause))
        for r, rule in enumerate(rules)
        for c, clause in enumerate(trigram_query(rule.pattern) or ())
        for t in clause
    ]
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("_r", "_c", "_t", "_size"), term))) for term in terms))
    table = postings.sparkSession.range(1).select(F.inline(rows))
    hits = postings.join(F.broadcast(table), "_t").groupBy("_key", "_r", "_c").agg(F.count("*").alias("_n"), F.first("_size").alias("_size"))
    return hits.where("_n = _size").groupBy("_key").agg(F.collect_set("_r").alias("_rules"))


def _spans(rule: Rule, order: int) -> Column:
    """The rule's matches in _text with start, order, end and kind; gaps between matches give the offsets."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.transform(F.slice(F.split("_text", rule.pattern, -1), F.lit(1), F.size(F.regexp_extract_all("_text", pattern, 0))), F.length).alias("gap"),
        F.transform(F.regexp_extract_all("_text", pattern, 0), F.length).alias("len"),
        F.transform(F.regexp_extract_all("_text", pattern, rule.group), F.length).alias("part"),
    )
    kind = "array<struct<start:int,order:int,end:int,kind:string,part:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), (start + x["len"]).alias("end"), F.lit(rule.kind).alias("kind"), x["part"].alias("part"))
        return F.struct((start + x["len"]).alias("at"), F.concat(acc["out"], F.array(span).cast(kind)).alias("out"))

    spans = F.filter(F.aggregate(found, zero, step)["out"], lambda s: s["part"] >= rule.least)
    asked = F.lit(True) if trigram_query(rule.pattern) is None else F.coalesce(F.array_contains("_rules", order), F.lit(False))
    return F.when(asked & F.col("_text").rlike(rule.pattern), spans).otherwise(F.array().cast(kind))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (start, order, end, kind, part) by start, then rule."""
    postings, named = build_index(docs, rules)
    found = materialize(candidates(postings, named, rules), "candidates")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    # a hint keeps one plan at every size: texts meet the candidates by shuffle
    rows = rows.hint("merge").join(found, "_key", "left")
    return rows.select("doc_id", F.array_sort(F.concat(*(_spans(r, i) for i, r in enumerate(rules)))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["order"] == k)).cast("long")

    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)),
        F.sha2(joined(F.filter("spans", lambda s: s["order"] < len(BASE))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    each, text = [], lambda s: s.replace("'", "''")
    for k, r in enumerate(RULES):
        p = f"'{text(r.pattern)}'"
        each.append(f"""SELECT rid, {k} AS k, '{r.kind}' AS kind,
          unnest([struct_pack(s := list_sum([0] || [length(x) FOR x IN g[1:i]]) + list_sum([0] || [length(x) FOR x IN m[1:i-1]]), l := length(m[i]), p := length(q[i])) FOR i IN range(1, len(m) + 1)]) AS v
          FROM (SELECT rid, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.group}) AS q, string_split_regex(t, {p}) AS g
                FROM d WHERE regexp_matches(t, {p})) WHERE len(m) > 0""")
    least = "CASE k " + " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(RULES)) + " END"
    n = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(each)}),
s AS (SELECT rid, k, v.s AS s, kind || ':' || v.s || ':' || (v.s + v.l) AS one FROM m WHERE v.p >= {least}),
a AS (SELECT rid, {counts}, string_agg(one, ',' ORDER BY s, k) AS spans,
             string_agg(one, ',' ORDER BY s, k) FILTER (WHERE k < {len(BASE)}) AS base FROM s GROUP BY rid)
SELECT doc_id, {n}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""


SQL = _sql()
