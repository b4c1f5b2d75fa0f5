"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import chat, htmltext, mixing, pieces, quality, repair, repeats, simhash, spelling, tokencounts, topk, toxicity, warc
from loomframe.llm.common import cut, shared_folder, table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix at weights 1, 2, 3 takes of every document."""
    mix = mixing.Mix(table(spark, sf_dir, "documents"))
    return mix.taken().select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", "taken")


def op2_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of an archive of all pages against a replica in which some records have rotted and some are lost."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.audit(*warc.replicas(pages, rotted(pages)))


def rotted(pages: DataFrame) -> DataFrame:
    """The pages as a failing disk would give them: about one in 200 has its first letter "e" overwritten, and one in 1000 is gone."""
    at = F.pmod(F.xxhash64("page_id", F.lit("rot")), F.lit(2000))
    spoiled = F.concat(F.substring_index("html", "e", 1), F.lit("\x00"), F.expr("substring(html, length(substring_index(html, 'e', 1)) + 2)"))
    return pages.filter(at < 1998).withColumn("html", F.when((at < 10) & F.contains("html", F.lit("e")), spoiled).otherwise(F.col("html")))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated unit of text to remove, with its place and the occurrence that stays."""
    return repeats.repeated(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after three batches over all documents, the first of them committed twice.

    All documents are inserted as one vocabulary counts them; those in other languages than English are revised to a
    second vocabulary; then all copies of a text but the first by id are deleted.
    """
    docs = table(spark, sf_dir, "documents").withColumn("text_hash", F.xxhash64("text"))
    rows = cut(tokencounts.counted(docs, ranks={"old_tokens": tokencounts.RANKS, "new_tokens": tokencounts.MULTI_RANKS}, keep=("doc_id", "source", "lang", "text_hash")))
    old, new = "byte_bpe_50k", "byte_bpe_multi_50k"
    rollup = tokencounts.Rollup(spark, f"{shared_folder(spark)}/token-totals-{uuid.uuid4().hex}")
    for _ in range(2):
        rollup.commit("insert", tokencounts.inserts(rows.withColumn("n_tokens", F.col("old_tokens")), old))
    other = F.coalesce(F.col("lang") != "en", F.lit(True))
    rollup.commit("revise", tokencounts.revisions(rows.filter(other).withColumn("n_tokens", F.col("new_tokens")), new, old=old))
    copies, rank = copied(rows)
    now = copies.withColumns({"n_tokens": F.when(other, F.col("new_tokens")).otherwise(F.col("old_tokens")), "n": F.col("n") - F.when(rank == F.col("first"), 1).otherwise(0)})
    rollup.commit("delete", tokencounts.deletes(now.filter("n > 0"), F.when(other, new).otherwise(old), F.col("n")))
    return rollup.totals()


def copied(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Texts that stand in several rows: a row for each id, source and language with their number n and the first such
    place of the text; and what compares with it. Rows are counted before texts meet, so a text with many copies is no hot key."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("source"), F.col("lang"))
    places = rows.groupBy("text_hash", "doc_id", "source", "lang", "old_tokens", "new_tokens").agg(F.count("*").alias("n"))
    first = places.groupBy("text_hash").agg(F.min(rank).alias("first"), F.sum("n").alias("total")).filter("total > 1")
    return places.join(first.hint("merge"), "text_hash"), rank


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, and whether decoding gives its text."""
    return pieces.encode(table(spark, sf_dir, "documents"), check=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the standard policy's verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.apply_policy(quality.ledger(docs), quality.STANDARD)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.failed(quality.BASE).alias("base_failed"), "kept", "fail_bits"
    )


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every 20th vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, by a model fitted to the labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of all conversations after some damage."""
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.reports(repair.edits(repair.damaged(talks)))
    every = talks.groupBy("conv_id").agg(F.struct("conv_id").alias("_key"))  # a struct, so that a null meets a null
    out = every.join(found.withColumn("_key", F.struct("conv_id")).drop("conv_id"), "_key", "left")
    empty = hashlib.sha256().hexdigest()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the form that each is a variant of."""
    return spelling.forms(spelling.words(table(spark, sf_dir, "documents")))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of one that quotes markers, read back from their formatted text."""
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.formatted(talks))


SQL: dict[str, str] = {}

#: CRC-32 of a list of bytes.
CRC = "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, ({})::UBIGINT[]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)))"
BYTES = "flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"

def _least(*nodes: str) -> str:
    return f"list_sort([{', '.join(nodes)}])[1]"


def _edit(node: str, cost: str, letter: str, row: str = "", when: str = "true") -> str:
    """A node's costs, letters and rows behind an edit, out of reach where it isn't allowed."""
    return f"{{'c': CASE WHEN {when} THEN {node}.c + {cost} ELSE 1000000000 END, 's': {node}.s || '{letter}', 'r': {node}.r{f' || chr(10) || {row}' if row else ''}}}"


def _rows(q: str) -> str:
    """The step over a row: keep it by its initial, rerole it to the role that a state wants, or delete it."""
    free, more = "fault IS DISTINCT FROM 'blank' AND fault IS DISTINCT FROM 'duplicate'", "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    keep = lambda q, x: _edit(q, f"({more})", "K", "role || ':' || text", f"{free} AND role[1] = '{x}'")  # noqa: E731
    turn = lambda q, name: _edit(q, f"(1 + {more})", "R", f"'{name}:' || text", free)  # noqa: E731
    ways = {"0": [], "1": [keep("i0", "s")], "2": [f(x, n) for x in ("i0", "i1", "i3") for f, n in ((keep, "u"), (turn, "user"))], "3": [keep("i2", "a"), turn("i2", "assistant")]}
    return _least(_edit(f"i{q}", "2", "D"), *ways[q])


#: Every letter is an edge of least cost, and of equal costs the least letters stand; nodes are compared as (cost, letters).
SQL["op11_repair"] = rf"""
WITH RECURSIVE raw AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS key, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
h AS (SELECT *, {CRC.format(BYTES.format("(key || ':' || coalesce(turn::VARCHAR, ' '))"))} % 20 AS h FROM raw),
d AS (SELECT key, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE h > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN regexp_extract(text, '([^ 	-])[ 	-]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
  CASE WHEN n > 1 THEN lag(role[1]) OVER (PARTITION BY key ORDER BY n) || role[1] NOT IN ('su', 'ua', 'au') ELSE false END AS illegal FROM o),
t AS (SELECT DISTINCT key, 0::BIGINT AS n, {{'c': 0::BIGINT, 's': '', 'r': ''}} AS q0, {{'c': 1000000000::BIGINT, 's': '', 'r': ''}} AS q1, {{'c': 1000000000::BIGINT, 's': '', 'r': ''}} AS q2, {{'c': 1000000000::BIGINT, 's': '', 'r': ''}} AS q3 FROM f
  UNION ALL SELECT key, n, {', '.join(_rows(q) for q in "0123")} FROM (SELECT t.key, f.n, role, text, fault, q0 AS i0, q1 AS i1, {_least("q2", *[_edit(q, "5", "I", "'user:'") for q in ("q0", "q1", "q3")])} AS i2, {_least("q3", _edit(_least("q2", *[_edit(q, "5", "I", "'user:'") for q in ("q0", "q1", "q3")]), "5", "I", "'assistant:'"))} AS i3, FROM t JOIN f ON t.key = f.key AND f.n = t.n + 1)),
e AS (SELECT key, {_least("q0", "q3", _edit("q2", "5", "I", "'assistant:'"), *[_edit(_edit(q, "5", "I", "'user:'"), "5", "I", "'assistant:'") for q in ("q0", "q1", "q3")])} AS best FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1),
c AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY key)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.s, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT key, conv_id FROM raw) a LEFT JOIN c USING (key) LEFT JOIN e USING (key)
"""

SQL["op12_spelling"] = rf"""
WITH RECURSIVE r AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)),
h AS (SELECT run, count(*) AS k, {CRC.format(BYTES.format("any_value(id || ':' || run)"))} AS h FROM r WHERE length(run) >= 7 GROUP BY id, run),
d AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
x AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT x.word, v.word FROM x JOIN v ON x.rest = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.rest = v.word),
b AS (SELECT p.word, count(*) AS n_near, min((-o.n, o.word)) AS best FROM p JOIN v o ON p.near = o.word GROUP BY p.word),
f AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -best[1] >= 10 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 10 * n THEN -best[1] END AS form_n FROM v LEFT JOIN b ON v.word = b.word),
w AS (SELECT word, word AS at FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON w.at = f.word WHERE f.form IS NOT NULL),
root AS (SELECT w.word, w.at AS root FROM w JOIN f ON w.at = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)
"""

SQL["op13_chat"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, 16 + length(regexp_replace(role || text, '([\\<>])', 'xx', 'g')) AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars FROM e GROUP BY conv_id
"""

SQL["op7_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM (SELECT DISTINCT * FROM v WHERE vec_id % 20 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

SQL["op6_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i+1], ws[i+2]) AS n FROM p),
c AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i+1, i+2]) AS j FROM g WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaims FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
  + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (2 * n_exclaims > n_words)::INT + 32 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT AS f FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f & 3) <> 0 AS base_failed, f = 0 AS kept, f::BIGINT AS fail_bits FROM b
"""

QUERIES = {f.__name__: f for f in (op1_mix, op2_merkle_audit, op3_repeats, op4_token_counts, op5_pieces, op6_quality_rules, op7_topk, op8_simhash, op9_toxicity, op10_html, op11_repair, op12_spelling, op13_chat)}
