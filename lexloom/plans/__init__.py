"""Registered queries over the driver's tables, and their SQL. Each runs over its whole tables and texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import native as N
from lexloom.functions import plain as P
from lexloom.functions import chunks, diffs, grounding, json_repair, markup, names, office, phonetics, randoms, scrub, sketches, stems
from lexloom.functions.columns import lift, lift_many, spans
from lexloom.operators import integrity, near_dup, retrieval
from lexloom.scratch import materialize
from lexloom.streaming import json_repair as json_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "normalize"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scalar(name: str, value: Callable[[Column], Column], sql: str | None = None, table: str = "documents", key: str = "doc_id", column: str = "text") -> None:
    """A query (key, value) of one column's function over a whole table."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, table).select(*key.split(", "), value(F.col(column)).alias("value"))

    QUERIES[name] = query
    if sql:
        ORACLE[name] = f"SELECT {key}, {sql} AS value FROM {table}"


# --- cleanup
_SPACE = r"[\t-\r\x{1c}-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NORM = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'),
  '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\A{_SPACE}+|{_SPACE}+\z', '', 'g')"""
scalar("normalize", N.normalize, _NORM)
scalar("finalize", lambda t: N.finalize(t)["sha256"], f"sha256({_NORM})")
scalar("strip_controls", N.strip_controls, r"regexp_replace(text, '[\x00-\x1f\x7f]+', ' ', 'g')")
scalar("nfc", N.nfc, "nfc_normalize(text)")
for _n in ("nfd", "nfkc", "nfkd"):
    scalar(_n, getattr(N, _n))
scalar("strip_accents", N.strip_accents, "strip_accents(text)")
scalar("collapse_whitespace", N.collapse_whitespace, rf"regexp_replace(regexp_replace(text, '{_SPACE}+', ' ', 'g'), '\A | \z', '', 'g')")
scalar("apply_pipeline", lambda t: N.collapse_whitespace(N.strip_accents(F.lower(t))), rf"regexp_replace(regexp_replace(strip_accents(lower(text)), '{_SPACE}+', ' ', 'g'), '\A | \z', '', 'g')")
scalar("html_unescape", lambda t: lift(P.html_unescape, "string", t), table="pages", key="page_id", column="html")
scalar("dedent", lambda t: lift(P.dedent, "string", t))

# --- codecs
scalar("decode_utf8", lambda t: N.decode_utf8(F.encode(t, "UTF-8")), "text")
scalar("finalize_utf8", lambda t: N.finalize(N.decode_utf8(F.encode(t, "UTF-8"), "replace"))["sha256"], f"sha256({_NORM})")
scalar("utf8_is_valid", lambda t: N.utf8_is_valid(F.encode(t, "UTF-8")), "text IS NOT NULL")
scalar("decode_utf16", lambda t: lift(P.decode_utf16, "string", F.encode(t, "UTF-16LE"), byteorder="little"), "text")
scalar("utf16_is_valid", lambda t: lift(P.utf16_is_valid, "boolean", F.encode(t, "UTF-16LE"), byteorder="little"), "text IS NOT NULL")
scalar("b64_encode_bytes", lambda t: N.b64_encode_bytes(F.encode(t, "UTF-8")), "base64(encode(text))")
scalar("b64_decode", lambda t: F.decode(lift(P.b64_decode, "binary", N.b64_encode_bytes(F.encode(t, "UTF-8"))), "UTF-8"), "text")
scalar("utf8_byte_len", N.utf8_byte_len, "strlen(text)::INTEGER")
scalar("utf16_byte_len", N.utf16_byte_len, r"(2 * length(text) + 2 * length(regexp_replace(text, '[^\x{10000}-\x{10FFFF}]', '', 'g')))::INTEGER")
scalar("detect_encoding", lambda t: lift(P.detect_encoding, "string", F.encode(t, "UTF-8")), "'UTF-8'")
# quotes behind one, two and three backslashes, made from the JSON's own
_ESCAPED = lambda t: F.replace(F.replace(t, F.lit('"'), F.lit('\\"')), F.lit(':'), F.concat(F.repeat(F.lit("\\"), F.pmod(F.length(t), F.lit(4))), F.lit('"')))
_ESCAPED_SQL = """replace(replace(props, '"', '\\"'), ':', repeat('\\', length(props) % 4) || '"')"""
_FOUND_SQL = f"regexp_extract({_ESCAPED_SQL}, '^((?:[^\\\\\"]|\\\\.)*)\"', 1)"
_HAS_SQL = f"regexp_matches({_ESCAPED_SQL}, '^(?:[^\\\\\"]|\\\\.)*\"')"
scalar("find_unescaped", lambda t: lift(P.find_unescaped, "int", F.encode(_ESCAPED(t), "UTF-8"), needle=b'"'), column="props", table="events", key="event_id", sql=f"CASE WHEN {_HAS_SQL} THEN strlen({_FOUND_SQL}) ELSE -1 END::INTEGER")
scalar("contains_unescaped", lambda t: lift(P.contains_unescaped, "boolean", F.encode(_ESCAPED(t), "UTF-8"), needle=b'"'), column="props", table="events", key="event_id", sql=_HAS_SQL)
scalar("quote", N.quote, "replace(url_encode(text), '%2F', '/')")
scalar("quote_plus", N.quote_plus, "replace(url_encode(text), '%20', '+')")
scalar("unquote", lambda t: lift(P.unquote, "string", N.quote(t)), "text")
scalar("unquote_plus", lambda t: lift(P.unquote_plus, "string", N.quote_plus(t)), "text")

# --- hashes
for _k in ("md5", "sha1", "sha256"):
    scalar(f"{_k}_hex", lambda t, k=_k: N.digest_hex(k, t), f"{_k}(text)")
    scalar(f"{_k}_digest", lambda t, k=_k: N.b64_encode_bytes(N.digest(k, t)), f"base64(unhex({_k}(text)))")
scalar("sha512_hex", lambda t: N.digest_hex("sha512", t))
scalar("sha512_digest", lambda t: N.b64_encode_bytes(N.digest("sha512", t)))
_PAD = lambda x: bytes(b ^ x for b in b"key".ljust(64, b"\0")).hex()
_HMAC = f"sha256(unhex('{_PAD(0x5C)}') || unhex(sha256(unhex('{_PAD(0x36)}') || encode(text))))"
scalar("hmac_sha256_hex", lambda t: N.hmac_sha256_hex(F.lit("key"), t), _HMAC)
scalar("hmac_sha256_digest", lambda t: N.b64_encode_bytes(F.unhex(N.hmac_sha256_hex(F.lit("key"), t))), f"base64(unhex({_HMAC}))")
scalar("content_hash", lambda t: lift(P.content_hash, "string", t), table="events", key="event_id", column="props")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in order of their ids, whose hashes are more than one round folds."""
    return read(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("idx"), F.col("props").alias("chunk"))


QUERIES["merkle_root"] = lambda spark, d: integrity.merkle_root(_chunks(spark, d))
ORACLE["merkle_root"] = """
WITH RECURSIVE t(lvl, i, h, n) AS (
  SELECT 0, event_id::BIGINT, sha256('\\x00'::BLOB || encode(props)), count(*) OVER () FROM events
  UNION ALL
  SELECT lvl + 1, i // 2, CASE WHEN count(*) = 2 THEN sha256('\\x01'::BLOB || unhex(min_by(h, i)) || unhex(max_by(h, i))) ELSE min(h) END, (any_value(n) + 1) // 2
  FROM t WHERE n > 1 GROUP BY lvl, i // 2)
SELECT h AS root FROM t WHERE n = 1"""


def _diff(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders")
    a = rows.select(F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("chunk"))
    return integrity.merkle_diff(a, rows.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("idx"), F.lit("F").alias("chunk")))


QUERIES["merkle_diff"] = _diff
ORACLE["merkle_diff"] = "SELECT o_orderkey AS idx FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority = '5-LOW'"

# --- segments and cuts
scalar("grapheme_count", N.grapheme_count, "length_grapheme(text)::INTEGER")
scalar("tokens", N.tokens, f"regexp_extract_all(lower(text), '{N.TOKEN.replace(chr(39), chr(39) * 2)}')")
scalar("word_bounds", lambda t: spans(P.word_bounds, t))
scalar("word_count", lambda t: lift(P.word_count, "int", t))
scalar("sentence_bounds", lambda t: spans(P.sentence_bounds, t))
scalar("sentence_count", lambda t: lift(P.sentence_count, "int", t))
for _f, _kw in (("chunk_by_words", {"n": 100, "overlap": 10}), ("chunk_by_sentences", {"n": 5}), ("chunk_by_lines", {"n": 3, "overlap": 1}), ("chunk_by_paragraphs", {"n": 2}), ("chunk_text", {"max_chars": 400})):
    scalar(_f, lambda t, f=_f, kw=_kw: spans(getattr(P, f), t, **kw))
scalar("truncate_to_bounds", lambda t: lift(P.truncate_to_bounds, "string", t, max_chars=80))
scalar("truncate_ellipsis", lambda t: lift(P.truncate_ellipsis, "string", t, max_chars=80), "CASE WHEN length(text) <= 80 THEN text ELSE left(text, 79) || '…' END")

# --- patterns, JSON, fences
_PATTERNS = {"the": "THE", "then": "THEN", "licensed under": "(c)", "Apache License": "AL"}
scalar("find_patterns", lambda t: lift(lambda x: [{"start": a, "end": b, "pattern": i} for a, b, i in P.matcher(list(_PATTERNS))(x)], "array<struct<start:int,end:int,pattern:int>>", t))
scalar("count_matches", lambda t: F.regexp_count(t, F.lit("licensed under|Apache License|then|the")), "len(regexp_extract_all(text, 'licensed under|Apache License|then|the'))::INTEGER")
scalar("replace_many", lambda t: lift(P.replace_many, "string", t, replacements=_PATTERNS), "replace(replace(replace(replace(text, 'licensed under', '(c)'), 'Apache License', 'AL'), 'then', 'THEN'), 'the', 'THE')")
scalar("replace_many_masked", lambda t: lift(P.replace_many, "string", t, replacements=_PATTERNS, mask="*"), "replace(replace(replace(replace(text, 'licensed under', '(c)***********'), 'Apache License', 'AL************'), 'then', 'THEN'), 'the', 'THE')")
scalar("first_invalid_charset", lambda t: lift(P.first_invalid_charset, "int", F.array(t), rest="abcdefghijklmnopqrstuvwxyz0123456789_", first="abcdefghijklmnopqrstuvwxyz"), column="event_type", table="events", key="event_id", sql="CASE WHEN regexp_full_match(event_type, '[a-z][a-z0-9_]*') THEN -1 ELSE 0 END::INTEGER")
scalar("json_is_valid", lambda t: lift(P.json_is_valid, "boolean", t), "json_valid(props)", "events", "event_id", "props")
scalar("extract_code_blocks", lambda t: lift(lambda x: [{"lang": a, "code": b, "start": c, "end": d} for a, b, c, d in P.extract_code_blocks(x)], "array<struct<lang:string,code:string,start:int,end:int>>", t), table="conversations", key="conv_id, turn")
scalar("strip_code_fences", lambda t: lift(P.strip_code_fences, "string", t))


# --- pairs: every customer's name beside that of the seventh next, or itself where there is none
def pair(name: str, value: Callable[[Column, Column], Column], sql: str | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("a"))
        d = c.select((F.col("c_custkey") - 7).alias("c_custkey"), F.col("a").alias("b"))
        return c.join(d, "c_custkey", "left").withColumn("b", F.coalesce("b", "a")).select("c_custkey", value(F.col("a"), F.col("b")).alias("value"))

    QUERIES[name] = query
    if sql:
        ORACLE[name] = f"SELECT c_custkey, {sql} AS value FROM (SELECT x.c_custkey, x.c_name AS a, coalesce(y.c_name, x.c_name) AS b FROM customer x LEFT JOIN customer y ON y.c_custkey = x.c_custkey + 7)"


pair("levenshtein", N.levenshtein, "levenshtein(a, b)::INTEGER")
pair("jaro", lambda a, b: F.round(lift(P.jaro, "double", a, b), 9), "round(jaro_similarity(a, b), 9)")
pair("jaro_winkler", lambda a, b: F.round(lift(P.jaro_winkler, "double", a, b), 9), "round(jaro_winkler_similarity(a, b), 9)")
pair("similarity_ratio", lambda a, b: lift(P.similarity_ratio, "double", a, b))
pair("shingle_jaccard", lambda a, b: lift(P.shingle_jaccard, "double", a, b, width=1))
pair("shingle_dice", lambda a, b: lift(P.shingle_dice, "double", a, b, width=1))
pair("is_grounded", lambda a, b: F.contains(b, a), "contains(b, a)")


def _grounded_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Whether 60 characters of a document, the 31st of them changed, are grounded in its whole text."""
    t = F.col("text")
    claim = F.concat(F.substring(t, 15, 30), F.lit("\u00a4"), F.substring(t, 46, 29))
    docs = read(spark, d, "documents").where(F.length("text") >= 75)
    return docs.select("doc_id", lift(grounding.is_grounded, "boolean", claim, t, fuzzy=True).alias("value"))


QUERIES["is_grounded_fuzzy"] = _grounded_fuzzy
pair("soundex", lambda a, b: F.soundex(F.regexp_replace(a, "[^A-Za-z]", "")))
scalar("refined_soundex", lambda t: lift(P.refined_soundex, "string", t), table="customer", key="c_custkey", column="c_name")
for _n in ("metaphone", "daitch_mokotoff"):
    scalar(_n, lambda t, f=_n: lift(getattr(phonetics, f), "string" if f == "metaphone" else "array<string>", t), table="nation", key="n_nationkey", column="n_name")
scalar("double_metaphone", lambda t: lift(lambda x: dict(zip(("first", "second"), phonetics.double_metaphone(x))), "struct<first:string,second:string>", t), table="nation", key="n_nationkey", column="n_name")

# --- near duplicates
_signed = lambda x: x - (1 << 64) if x >> 63 else x
scalar("simhash64", lambda t: lift(lambda x: _signed(P.simhash(x)), "long", t))
scalar("simhash128", lambda t: lift(lambda x: format(P.simhash(x, 128), "032x"), "string", t))


def _distance(spark: SparkSession, d: str) -> DataFrame:
    """Of two products of each line's keys, which have bits all over."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 2_654_435_761).alias("a"), (F.col("l_partkey") * -40_503_000_017).alias("b"))
    return rows.select("l_orderkey", "l_linenumber", N.simhash_distance(F.col("a"), F.col("b")).alias("value"))


QUERIES["simhash_distance"] = _distance
ORACLE["simhash_distance"] = "SELECT l_orderkey, l_linenumber, bit_count(xor(l_orderkey::BIGINT * 2654435761, l_partkey::BIGINT * -40503000017))::INTEGER AS value FROM lineitem"


def _lsh(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.round(N.lsh_probability(F.least(F.col("value") / 1000, F.lit(1.0)), 16, 8), 9).alias("value"))


QUERIES["lsh_probability"] = _lsh
ORACLE["lsh_probability"] = "SELECT event_id, round(1 - pow(1 - pow(least(value / 1000, 1.0), 8), 16), 9) AS value FROM events"
QUERIES["lsh_threshold"] = lambda spark, d: spark.range(1).select(F.round(F.lit(N.lsh_threshold(16, 8)), 9).alias("value"))
ORACLE["lsh_threshold"] = "SELECT round(pow(1 / 16.0, 1 / 8.0), 9) AS value"
QUERIES["chunk_overlap_cost"] = lambda spark, d: read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.chunk_overlap_cost(F.col("l_discount")), 9).alias("value"))
ORACLE["chunk_overlap_cost"] = "SELECT l_orderkey, l_linenumber, round(1 / (1 - l_discount), 9) AS value FROM lineitem"

# --- retrieval
_TOK = N.TOKEN.replace("'", "''")


def _tf_idf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.tf_idf(read(spark, d, "documents")).withColumn("score", F.round("score", 6))


QUERIES["tf_idf"] = _tf_idf
ORACLE["tf_idf"] = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term)
SELECT doc_id, term, tf, df, round(tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1), 6) AS score FROM c JOIN f USING (term)"""


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_rank(read(spark, d, "documents"), "licensed under the license").withColumn("score", F.round("score", 6))


QUERIES["bm25_rank"] = _bm25
ORACLE["bm25_rank"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_TOK}') AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d),
q AS (SELECT unnest(['licensed', 'under', 'the', 'license']) AS term),
m AS (SELECT doc_id, len(t) AS l, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, q),
f AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM m GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 6) AS score
FROM m JOIN f USING (term), s GROUP BY doc_id"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """For each region's nations' customers: a list per market segment, by balance."""
    c = read(spark, d, "customer")
    by = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return c.select(F.col("c_mktsegment").alias("list_id"), F.row_number().over(by).alias("pos"), F.col("c_nationkey").alias("id"), F.col("c_acctbal").alias("score"))


_LISTS = """l AS (SELECT c_mktsegment AS list_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS pos, c_nationkey AS id, c_acctbal AS score FROM customer),
g AS (SELECT list_id, id, min(pos) AS pos, arg_min(score, pos) AS score FROM l GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY pos) AS rank, count(*) OVER (PARTITION BY list_id) AS n,
      min(score) OVER (PARTITION BY list_id) AS lo, max(score) OVER (PARTITION BY list_id) AS hi FROM g)"""
_SCALED = "CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END"
_WEIGHTS = {"BUILDING": 2.0, "MACHINERY": 0.5}
_WEIGHT = "CASE list_id WHEN 'BUILDING' THEN 2.0::DOUBLE WHEN 'MACHINERY' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"
for _name, _build, _expr in (
    ("rank_fuse", retrieval.rank_fuse, "sum(1.0::DOUBLE / (60 + rank))"),
    ("score_fuse_combmnz", lambda x: retrieval.score_fuse(x, "combmnz"), f"sum({_SCALED}) * count(*)"),
    ("score_fuse_linear", lambda x: retrieval.score_fuse(x, "linear"), f"sum({_SCALED})"),
    ("score_fuse_borda", lambda x: retrieval.score_fuse(x, "borda"), "sum((n - rank)::DOUBLE / n)"),
    ("rank_fuse_weighted", lambda x: retrieval.rank_fuse(x, weights=_WEIGHTS), f"sum({_WEIGHT} / (60 + rank))"),
    ("score_fuse_weighted", lambda x: retrieval.score_fuse(x, "combmnz", _WEIGHTS), f"sum({_WEIGHT} * {_SCALED}) * count(*)"),
):
    QUERIES[_name] = lambda spark, d, b=_build: b(_lists(spark, d)).withColumn("score", F.round("score", 6))
    ORACLE[_name] = f"WITH {_LISTS} SELECT id, round({_expr}, 6) AS score FROM f GROUP BY id"


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    ranked = docs.select(F.col("lang").alias("list_id"), F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"), F.col("doc_id").alias("id"))
    gains = read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(1.0).alias("gain"))
    out = retrieval.metrics(ranked, gains, 50)
    return out.select("list_id", *(F.round(c, 6).alias(c) for c in ("mrr", "recall", "precision", "ndcg")))


QUERIES["ranking_metrics"] = _metrics
ORACLE["ranking_metrics"] = """
WITH r AS (SELECT lang AS list_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
g AS (SELECT doc_id FROM labels WHERE quality = 1), h AS (SELECT r.*, g.doc_id IS NOT NULL AS rel FROM r LEFT JOIN g USING (doc_id))
SELECT list_id, round(coalesce(1.0 / min(rank) FILTER (WHERE rel), 0), 6) AS mrr,
  round(count(*) FILTER (WHERE rel AND rank <= 50) / (SELECT count(*) FROM g), 6) AS recall,
  round(count(*) FILTER (WHERE rel AND rank <= 50) / 50, 6) AS precision,
  round(coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rel AND rank <= 50), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 51) t(i) WHERE i <= (SELECT count(*) FROM g)), 6) AS ndcg
FROM h GROUP BY list_id"""
for _name, _column in {"mrr": "mrr", "recall_at_k": "recall", "precision_at_k": "precision", "ndcg_at_k": "ndcg"}.items():
    QUERIES[_name] = lambda spark, d, c=_column: _metrics(spark, d).select("list_id", F.col(c).alias("value"))
    ORACLE[_name] = f"SELECT list_id, {_column} AS value FROM ({ORACLE['ranking_metrics']})"


# --- one row for each span
def each(name: str, value: Callable[[Column], Column], table: str = "documents", key: str = "doc_id") -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = read(spark, sf_dir, table).select(key, F.posexplode(value(F.col("text"))).alias("n", "_s"))
        return found.select(key, "n", "_s.*")

    QUERIES[name] = query


each("word_bounds_iter", lambda t: spans(P.word_bounds, t))
each("sentence_bounds_iter", lambda t: spans(P.sentence_bounds, t))
for _f, _kw in (("chunk_by_words", {"n": 100, "overlap": 10}), ("chunk_by_sentences", {"n": 5}), ("chunk_by_lines", {"n": 3, "overlap": 1}), ("chunk_by_paragraphs", {"n": 2}), ("chunk_text", {"max_chars": 400})):
    each(f"{_f}_iter", lambda t, f=_f, kw=_kw: spans(getattr(P, f), t, **kw))
_ANY = "licensed under|Apache License|then|the"
_NUMBER = "CASE x " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(_PATTERNS)) + " END"
ORACLE["find_patterns_iter"] = f"""
WITH m AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(text, '{_ANY}') AS m, string_split_regex(text, '{_ANY}') AS g FROM documents WHERE regexp_matches(text, '{_ANY}')),
s AS (SELECT rid, doc_id, unnest([struct_pack(n := i - 1, a := list_sum([length(y) FOR y IN g[1:i]]) + list_sum([0] || [length(y) FOR y IN m[1:i-1]]), x := m[i]) FOR i IN range(1, len(m) + 1)], recursive := true) FROM m)
SELECT doc_id, n::INTEGER AS n, a::INTEGER AS start, (a + length(x))::INTEGER AS "end", ({_NUMBER})::INTEGER AS pattern FROM s"""
each("find_patterns_iter", lambda t: lift(lambda x: [{"start": a, "end": b, "pattern": i} for a, b, i in P.matcher(list(_PATTERNS))(x)], "array<struct<start:int,end:int,pattern:int>>", t))

# --- more chunks
scalar("chunk_hierarchical", lambda t: spans(chunks.chunk_hierarchical, t, max_chars=400))
scalar("chunk_to_budget", lambda t: spans(lambda x: chunks.chunk_to_budget(x, lambda y: len(y.split()), 100, 10), t))
scalar("chunk_to_offsets", lambda t: spans(lambda x: chunks.chunk_to_offsets(x, [(a, b) for a, b in P.word_bounds(x) if not x[a:b].isspace()], 120, 12), t))
scalar("chunk_quality", lambda t: lift(lambda x: chunks.chunk_quality(P.chunk_by_sentences(x, 3), x), "struct<integrity:double,cohesion:double>", t))
scalar("chunk_cdc", lambda t: spans(chunks.chunk_cdc, F.encode(t, "UTF-8"), min_size=256, avg_size=1024, max_size=8192))

# --- redaction
_REPORT = "struct<text:string,redacted:int,spans:array<struct<rule:string,start:int,end:int>>>"
for _f in ("scrub_pii", "scrub_secrets", "scrub_log_text"):
    scalar(_f, lambda t, f=_f: lift(getattr(scrub, f), "string", t))
for _f in ("scrub_pii_report", "scrub_secrets_report"):
    scalar(_f, lambda t, f=_f: lift(getattr(scrub, f), _REPORT, t))
scalar("first_invalid_offender", lambda t: F.try_element_at(F.regexp_extract_all(t, F.lit("[^a-z0-9_]"), 0), F.lit(1)), column="event_type", table="events", key="event_id", sql="nullif(regexp_extract(event_type, '[^a-z0-9_]'), '')")

# --- repair, markup, stems
scalar("repair_json", lambda t: lift(json_repair.repair_json, "string", F.expr("substring(props, 1, length(props) - 1)")), table="events", key="event_id", column="props")
scalar("repair_json_diagnostics", lambda t: lift(lambda x: [a["action"] for a in json_repair.repair_json_diagnostics(x)[1]], "array<string>", F.expr("substring(props, 1, length(props) - 1)")), table="events", key="event_id", column="props")
scalar("repair_json_loads", lambda t: lift(lambda x: type(json_repair.repair_json_loads(x)).__name__, "string", t), table="events", key="event_id", column="props")


def _repair_stream(spark: SparkSession, d: str) -> DataFrame:
    """Each event's properties in three chunks; the closing bracket is lost on the way."""
    parts = "posexplode(array(substring(props, 1, 5), substring(props, 6, 5), substring(props, 11, greatest(0, length(props) - 11)))) AS (seq, chunk)"
    rows = read(spark, d, "events").selectExpr("event_id AS stream_id", parts)
    found = json_stream.repair_json_stream(rows.selectExpr("*", "seq = 2 AS last"))
    return found.select(F.col("stream_id").cast("long").alias("event_id"), "value", "ended")


QUERIES["repair_json_stream"] = _repair_stream
scalar("to_markdown", lambda t: lift(markup.html_to_markdown, "string", t), table="pages", key="page_id", column="html")
scalar("to_text", lambda t: lift(markup.html_to_text, "string", t), table="pages", key="page_id", column="html")
# what CSV and RTF files of customers would hold
_CSV = lambda: F.encode(F.concat_ws("\n", F.lit("name,segment"), F.concat_ws(",", F.concat(F.lit('"'), "c_name", F.lit('"')), "c_mktsegment")), "UTF-8")
_RTF = lambda: F.encode(F.concat(F.lit("{\\rtf1\\ansi{\\info{\\author x}}"), F.col("c_name"), F.lit("\\par {\\b "), F.col("c_mktsegment"), F.lit("}}")), "UTF-8")
_FILE = "struct<value:string,error:string>"
scalar("to_markdown_csv", lambda _: lift(lambda x: office.converted(x, "csv"), _FILE, _CSV())["value"], "'| name | segment |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_name || ' | ' || c_mktsegment || ' |'", "customer", "c_custkey", "c_name")
scalar("to_text_rtf", lambda _: lift(lambda x: office.converted(x, "rtf", True), _FILE, _RTF())["value"], "c_name || chr(10) || chr(10) || c_mktsegment", "customer", "c_custkey", "c_name")
scalar("sniff", lambda t: markup.sniff(F.encode(t, "UTF-8")), table="pages", key="page_id", column="html")
scalar("apply_pipeline_stemmed", lambda t: lift(stems.apply_terms, "string", N.collapse_whitespace(N.strip_accents(F.lower(t))), stemmer="english"))

# --- pairs
_OPCODES = "array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>"
_ops = lambda found: [dict(zip(("tag", "i1", "i2", "j1", "j2"), x)) for x in found]
pair("diff_opcodes", lambda a, b: lift(lambda x, y: _ops(diffs.diff_opcodes(x, y)), _OPCODES, a, b))
pair("diff_opcodes_lines", lambda a, b: lift(lambda x, y: _ops(diffs.diff_opcodes_lines(x, y)), _OPCODES, F.replace(a, F.lit("#"), F.lit("\n")), F.replace(b, F.lit("#"), F.lit("\n"))))
scalar("nysiis", lambda t: lift(names.nysiis, "string", t), table="customer", key="c_custkey", column="c_name")
pair("grounding_coverage", lambda a, b: lift(grounding.grounding_coverage, "double", a, b))
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
scalar("get_close_matches", lambda t: lift(P.get_close_matches, "array<string>", t, possibilities=_SEGMENTS, cutoff=0.3), table="customer", key="c_custkey", column="c_mktsegment")

# --- grounding: what users said in what was answered
_SNIPPETS = "struct<snippets:array<struct<text:string,start:int,end:int,score:double>>,score:double>"
_SENTENCES = "struct<sentences:array<struct<text:string,start:int,end:int,score:double>>,score:double>"
scalar("highlight", lambda t: lift(lambda x: grounding.highlight("licensed under the license", x), _SNIPPETS, t))
scalar("ground_sentences", lambda t: lift(lambda x: grounding.ground_sentences(x, "licensed under the license"), _SENTENCES, t))


def _grounding_report(spark: SparkSession, d: str) -> DataFrame:
    """Each turn against the turn before it, a first one against itself."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "text")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    verdict = lift(lambda x, y: {k: float(v) for k, v in grounding.grounding_report(x, [y])["aggregate"].items()}, "struct<grounded_ratio:double,mean_score:double,best_score:double,coverage:double>", "text", "source")
    return c.join(before, ["conv_id", "turn"], "left").withColumn("source", F.coalesce("source", "text")).select("conv_id", "turn", verdict.alias("value"))


QUERIES["grounding_report"] = _grounding_report

# --- sketches
scalar("minhash_signature", lambda t: lift(lambda x: sketches.signed(sketches.minhash_signature(x)), "array<long>", t))
scalar("weighted_minhash_signature", lambda t: lift(lambda x: [{"hash": h - (1 << 64) if h >> 63 else h, "level": k} for h, k in sketches.weighted_minhash_signature(x, 16)], "array<struct<hash:long,level:long>>", t))


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), lift(lambda x: sketches.signed(sketches.minhash_signature(x)), "array<long>", text).alias("sig"))


def _jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Each document against the next one, or itself where there is none."""
    a = materialize(_signatures(spark, d), "signatures")
    b = a.select((F.col("id") - 1).alias("id"), F.col("sig").alias("_b"))
    return a.join(b, "id", "left").select("id", N.minhash_jaccard(F.col("sig"), F.coalesce("_b", "sig")).alias("value"))


QUERIES["minhash_jaccard"] = _jaccard


def _weighted_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Each document against its own text in capitals and without its first 40 characters."""
    kind = "array<struct<hash:long,level:long>>"
    sign = lambda t: lift(lambda x: [dict(zip(("hash", "level"), (sketches.signed([h])[0], k))) for h, k in sketches.weighted_minhash_signature(x, 16)], kind, t)
    t = F.coalesce("text", F.lit(""))
    return read(spark, d, "documents").select("doc_id", N.minhash_weighted_jaccard(sign(t), sign(F.expr("substring(upper(coalesce(text, '')), 41)"))).alias("value"))


scalar("superminhash_signature", lambda t: lift(lambda x: sketches.signed(sketches.superminhash_signature(x)), "array<long>", t))
QUERIES["minhash_weighted_jaccard"] = _weighted_jaccard
QUERIES["lsh_candidates"] = lambda spark, d: near_dup.lsh_candidates(materialize(_signatures(spark, d), "signatures"), 16, 8)
for _m in ("simhash", "shingle", "minhash"):
    QUERIES[f"dedup_near_dup_{_m}"] = lambda spark, d, m=_m: near_dup.dedup_near_dup(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 0.9, m)

# --- tokens and UUIDs
for _f, _n, _letters in (("random_hex", 22, randoms.HEX_LOWER), ("random_b62", 22, randoms.B62), ("random_b64url", 22, randoms.B64URL), ("random_string", 12, "abcdef")):
    scalar(_f, lambda t, n=_n, a=_letters: lift_many(lambda rows: randoms.random_strings(n, a, [x for (x,) in rows]), "string", t), table="events", key="event_id", column="event_id")
scalar("uuid4", lambda t: N.uuid_version(N.uuid4()), "4::INTEGER", table="events", key="event_id", column="event_id")
scalar("uuid4_bytes", lambda t: F.octet_length(N.uuid_parse(N.uuid4())), "16::INTEGER", table="events", key="event_id", column="event_id")
scalar("uuid7", lambda t: N.uuid_version(N.uuid7()), "7::INTEGER", table="events", key="event_id", column="event_id")
scalar("uuid7_bytes", lambda t: F.octet_length(N.uuid_parse(N.uuid7())), "16::INTEGER", table="events", key="event_id", column="event_id")
_MD5_PARTS = ", ".join(f"substr(md5(props), {a}, {n})" if n else f"'{a}'" for a, n in ((1, 8), ("-", 0), (9, 4), ("-7", 0), (14, 3), ("-8", 0), (18, 3), ("-", 0), (21, 12)))
_U7 = f"concat({_MD5_PARTS})"
scalar("uuid_version", lambda t: N.uuid_version(F.expr(_U7)), "7::INTEGER", "events", "event_id", "props")
scalar("uuid_parse", lambda t: F.lower(F.hex(N.uuid_parse(F.expr(_U7)))), f"replace({_U7}, '-', '')", "events", "event_id", "props")
scalar("uuid7_timestamp_ms", lambda t: N.uuid7_timestamp_ms(F.expr(_U7)), "('0x' || substr(md5(props), 1, 12))::BIGINT", "events", "event_id", "props")
