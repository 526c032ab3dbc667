"""The operators as queries over the test tables, with SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import blob_ledger, chat, conversation_repair, decontamination, divergence, huffman, language, line_dedup, order_minhash, packing, projection_ann, suffix_dedup, warc
from feedloom.llm.common import read_table
from feedloom.operators import scale

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle if SQL has one."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_SQL_BASE32 = "||".join(
    f"substr({_BASE32}, (('0x' || substr(digest, {1 + 5 * (i // 4)}, 5))::BIGINT >> {15 - 5 * (i % 4)} & 31)::INT + 1, 1)"
    for i in range(32)
)


@query(f"""
WITH told AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages
), firsts AS (SELECT digest, max(page_id) AS first FROM told GROUP BY digest)
SELECT page_id, payload_bytes, {_SQL_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM told JOIN firsts USING (digest)""")
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through archives; the digest as bare upper-case base32."""
    read = warc.archived(read_table(spark, sf_dir, "pages"))
    return read.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, written as Huffman blocks and read back."""
    docs = read_table(spark, sf_dir, "documents")
    read = huffman.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read.withColumnRenamed("id", "doc_id")


@query()
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens, by balanced cost."""
    docs = read_table(spark, sf_dir, "documents")
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0).withColumnRenamed("id", "doc_id")


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@query(f"""
WITH doc AS (SELECT doc_id, {_SQL_WORDS} AS words FROM documents),
item AS (SELECT item_id, {_SQL_WORDS} AS words FROM benchmark),
item_window AS (
    SELECT DISTINCT item_id, m, list_aggregate(words[i : i + m - 1], 'string_agg', ' ') AS win
    FROM (SELECT item_id, words, m, unnest(range(1, len(words) - m + 2)) AS i
          FROM (SELECT *, least(13, len(words)) AS m FROM item WHERE len(words) > 0))
),
doc_window AS (
    SELECT doc_id, m, i, list_aggregate(words[i : i + m - 1], 'string_agg', ' ') AS win
    FROM (SELECT doc_id, words, m, unnest(range(1, len(words) - m + 2)) AS i
          FROM doc, (SELECT DISTINCT m FROM item_window) WHERE len(words) >= m)
),
hit AS (SELECT doc_id, i, m, item_id FROM doc_window JOIN item_window USING (m, win)),
counted AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM hit) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(counted.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(counted.n, 0) > 0 AND 20 * coalesce(counted.n, 0) >= len(words) AS contaminated
FROM doc LEFT JOIN counted USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of the benchmark have."""
    told = decontamination.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return told.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


@query()
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the documents not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = language.learned(docs.select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "text")
    return language.identify(rows, model, keep=["doc_id", "held_out"])


# Fixed value: the text that tries the template's marks and escapes.
TRIAL = r"\### Assistant: </turn> ok"
_SQL_ESCAPED = "length(regexp_replace({}, '[\\\\#<:]', 'xx', 'g'))"


@query(f"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{TRIAL}'), (-7, 1, 'assistant', '{TRIAL}')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({_SQL_ESCAPED.format("role")} + {_SQL_ESCAPED.format("text")} + 14)::BIGINT AS formatted_chars
FROM said GROUP BY conv_id""")
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that is hard to escape, formatted and read back."""
    hard = spark.createDataFrame([(-7, 0, "user", TRIAL), (-7, 1, "assistant", TRIAL)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return chat.read_back(scale.stage(chat.formatted(rows.unionByName(hard))))


@query()
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector among all others."""
    rows = read_table(spark, sf_dir, "embeddings")
    index = projection_ann.build_index(rows, "vec_id", "embedding")
    return projection_ann.nearest(index, rows.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding")


@query()
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document: the least id of its near copies."""
    return order_minhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query("""
WITH line AS (
    SELECT doc_id, no, line, list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '') AS w
    FROM (SELECT doc_id, unnest(range(len(ls))) AS no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
),
firsts AS (SELECT w, len(w) AS n, w[1:5] AS head, w[-5:] AS tail, min((doc_id, no)) AS place FROM line WHERE len(w) > 0 GROUP BY w),
pair AS (
    SELECT a.w AS w, b.w AS v FROM firsts a JOIN firsts b ON a.head = b.head AND b.place < a.place AND abs(a.n - b.n) <= 1 WHERE a.n >= 10 AND b.n >= 10
    UNION SELECT a.w, b.w FROM firsts a JOIN firsts b ON a.tail = b.tail AND b.place < a.place AND abs(a.n - b.n) <= 1 WHERE a.n >= 10 AND b.n >= 10
),
measured AS (
    SELECT w, v,
           len(list_filter(range(1, least(len(w), len(v)) + 1), lambda i: w[1:i] = v[1:i])) AS same_head,
           len(list_filter(range(1, least(len(w), len(v)) + 1), lambda i: w[-i:] = v[-i:])) AS same_tail
    FROM pair
),
edited AS (SELECT DISTINCT w FROM measured WHERE same_head + same_tail >= greatest(len(w), len(v)) - 1),
judged AS (
    SELECT line.*, len(w) > 0 AND (doc_id, no) <> place AS exact, len(w) > 0 AND (doc_id, no) = place AND e.w IS NOT NULL AS near
    FROM line LEFT JOIN firsts USING (w) LEFT JOIN edited e USING (w)
)
SELECT doc_id, count(*)::INT AS n_lines, coalesce(sum(exact::INT), 0)::INT AS n_exact, coalesce(sum(near::INT), 0)::INT AS n_edited,
       md5(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT coalesce(exact, false) AND NOT coalesce(near, false)), '')) AS text_md5
FROM judged GROUP BY doc_id""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines seen before, as a digest of its text."""
    docs = line_dedup.without_seen_lines(read_table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_exact").cast("int").alias("n_exact"),
        F.col("_n_edited").cast("int").alias("n_edited"), F.md5("text").alias("text_md5"),
    )


@query()
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 200 that repeat."""
    return suffix_dedup.without_repeats(read_table(spark, sf_dir, "documents"))


def _sql_least(*states: str) -> str:
    """The least (cost, audit, turns) of some states."""
    return f"list_sort([{', '.join(states)}])[1]"


def _sql_edit(state: str, cost: str, letter: str, turn: str | None = None) -> str:
    said = f"{state}.said || [{turn}]" if turn else f"{state}.said"
    return f"{{cost: {state}.cost + {cost}, audit: {state}.audit || '{letter}', said: {said}}}"


def _sql_made(start: str, system: str, user: str, assistant: str) -> str:
    """States after turns may have been made up: columns st, sy, us, an."""
    users = [_sql_edit(x, "5", "I", "'user:'") for x in (start, system, assistant)]
    us = _sql_least(user, *users)
    return f"{start} AS st, {system} AS sy, {us} AS us, {_sql_least(assistant, _sql_edit(us, '5', 'I', chr(39) + 'assistant:' + chr(39)))} AS an"


_SQL_NEVER = "{cost: 1000000000::BIGINT, audit: '', said: []::VARCHAR[]}"


def _sql_step() -> dict[str, str]:
    """States after one row, by what the output ends with."""

    def stays(initial: str, state: str) -> str:
        edit = _sql_edit(state, "more", "K", "role || ':' || text")
        return f"CASE WHEN may AND initial = '{initial}' THEN {edit} ELSE {_SQL_NEVER} END"

    def retold(name: str, state: str) -> str:
        edit = _sql_edit(state, "more + 1", "R", f"'{name}:' || text")
        return f"CASE WHEN may THEN {edit} ELSE {_SQL_NEVER} END"

    gone = {x: _sql_edit(x, "2", "D") for x in ("st", "sy", "us", "an")}
    before_user = ("st", "sy", "an")
    return {
        "st": gone["st"],
        "sy": _sql_least(gone["sy"], stays("s", "st")),
        "us": _sql_least(gone["us"], *[stays("u", x) for x in before_user], *[retold("user", x) for x in before_user]),
        "an": _sql_least(gone["an"], stays("a", "us"), retold("assistant", "us")),
    }


@query(f"""
WITH RECURSIVE place AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations
),
-- The checksum of the place, byte by byte and bit by bit.
fate AS (
    SELECT * EXCLUDE place, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(place)), lambda i: ascii(place[i + 1])::BIGINT)),
        lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) % 20 AS fate
    FROM place
),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
           CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
    FROM fate WHERE fate <> 0
),
ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS nth,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS told,
           regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
    FROM damaged
),
judged AS (
    SELECT conv_id, turn, role, text, nth, role[1] AS initial,
           CASE WHEN last = '' THEN 'blank' WHEN told > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           fault NOT IN ('blank', 'duplicate') AS may, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more
    FROM ordered
),
faulty AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated
    FROM judged GROUP BY conv_id
),
broken AS (
    SELECT conv_id, count(*) FILTER (former IS NOT NULL AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT conv_id, initial, lag(initial) OVER (PARTITION BY conv_id ORDER BY nth) AS former FROM judged) GROUP BY conv_id
),
search AS (
    SELECT conv_id, 0::BIGINT AS nth, {_sql_made("{cost: 0::BIGINT, audit: '', said: []::VARCHAR[]}", _SQL_NEVER, _SQL_NEVER, _SQL_NEVER)}
    FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, nth, {_sql_made("st", "sy", "us", "an")} FROM (
        SELECT s.conv_id, j.nth, {", ".join(f"{sql} AS {x}" for x, sql in _sql_step().items())}
        FROM search s JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND j.nth = s.nth + 1
    )
),
ended AS (SELECT conv_id, arg_max({_sql_least("st", "an")}, nth) AS best FROM search GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit,
       sha256(array_to_string(best.said, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN faulty c ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN broken b ON e.conv_id IS NOT DISTINCT FROM b.conv_id""")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged by a hash of each turn's place, and repaired."""
    told = conversation_repair.repaired(conversation_repair.damaged(read_table(spark, sf_dir, "conversations")), dropped="dropped")
    return told.withColumn("repaired_sha256", conversation_repair.digest(F.col("turns"))).drop("turns")


def _sql_found(rule: blob_ledger.Rule, nth: int) -> str:
    """Matches of a rule with their places: what lies between them is measured."""
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, no, {nth} AS nth, '{rule.name}' AS kind, found, measured,
        list_sum([length(x) for x in gaps[1:i]])::BIGINT + coalesce(list_sum([length(x) for x in all_found[1:i - 1]])::BIGINT, 0) AS start
    FROM (SELECT *, unnest(all_found) AS found, unnest(all_measured) AS measured, unnest(range(1, len(all_found) + 1)) AS i FROM (
        SELECT doc_id, no, regexp_extract_all(text, '{pattern}') AS all_found, regexp_extract_all(text, '{pattern}', {rule.measured}) AS all_measured,
               regexp_split_to_array(text, '{pattern}') AS gaps FROM said))
    WHERE length(measured) >= {rule.least}"""


def _sql_listed(which: str) -> str:
    return f"coalesce(string_agg(kind || ':' || start || ':' || start + length(found), ',' ORDER BY start, nth) FILTER ({which}), '')"


@query(f"""
WITH said AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS no FROM documents),
found AS ({" UNION ALL ".join(_sql_found(r, n) for n, r in enumerate(blob_ledger.RULES))}),
told AS (
    SELECT no, count(*) FILTER (nth = 0) AS n_assign, count(*) FILTER (nth = 1) AS n_access, count(*) FILTER (nth = 2) AS n_hex,
           {_sql_listed("nth < 3")} AS base, {_sql_listed("true")} AS spans
    FROM found GROUP BY no
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM said LEFT JOIN told USING (no)""")
def op11_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: each distinct text scanned once, for all rules."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = scale.new_path(spark, "ledger")
    blob_ledger.scan(docs, ledger, "text")
    told = blob_ledger.report(docs, ledger, "text")
    found = F.col("findings")
    return told.select(
        "doc_id", *[blob_ledger.counted(found, r.name).alias(f"n_{r.name}") for r in blob_ledger.BASE],
        F.sha2(blob_ledger.listed(found, [r.name for r in blob_ledger.BASE]), 256).alias("base_sha256"),
        blob_ledger.listed(found).alias("spans"),
    )


_SQL_SHARE = "(1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (n + 5 * v))::BIGINT"


@query(f"""
WITH said AS (
    SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
),
used AS (SELECT no, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM said),
kept AS (SELECT lang, term FROM used GROUP BY lang, term HAVING count(DISTINCT no) >= 30),
counts AS (SELECT lang, source, term, count(*) AS c FROM used JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
terms AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
told AS (
    SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0)::HUGEINT AS n
    FROM (SELECT DISTINCT lang, source FROM said) LEFT JOIN terms USING (lang) LEFT JOIN sums USING (lang, source)
),
p AS (
    SELECT told.lang, told.source, term, coalesce(c, 0) AS c, {_SQL_SHARE} AS p
    FROM told JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
),
q AS (
    SELECT lang, term, {_SQL_SHARE} AS q FROM (SELECT lang, term, sum(c) AS c FROM counts GROUP BY ALL)
    JOIN (SELECT lang, any_value(v) AS v, sum(n) AS n FROM told GROUP BY lang) USING (lang)
),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pair AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM told a JOIN told b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pair UNION ALL FROM term)
) WHERE part = 'pair' OR rank <= 50""")
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each language compared in pairs, and their own terms."""
    return divergence.audit(read_table(spark, sf_dir, "documents"))
