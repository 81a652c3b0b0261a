"""The numbered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline.llm import chat_format, lang_id, lexical, ngram_join, packing, quality_model, quality_rules, repair, simhash, token_files, toxicity, url_filter
from kithline.llm import decontaminate as contamination
from kithline.llm.common import crc_fold, fresh_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.array_join(F.array_sort("out.items"), ",")
    return found.select("row.doc_id", "out.n_words", "out.n_hit", F.size("out.items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), contamination.is_contaminated().alias("contaminated"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, keep=["doc_id"]).select("row.doc_id", (F.coalesce(crc_fold("row.doc_id") == 2, F.lit(False))).alias("held_out"), "out.severity", "out.p_toxic", "out.grade", (F.col("out.p_toxic") >= toxicity.TOXIC).alias("toxic"))


#: The tokenizer file, by the name it has among the public tokenizers.
TOKENIZER = "byte_bpe_50k.json"
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
CONTROL = "<|im_end|><|im_start|>assistant ok"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer_path(), added=True)
    found = token_files.read_tokens(spark, path, token_files.crc32_ids, "ids_crc32 long")
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.apply_rules(docs, base="n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), added=True)


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.score_quality(docs, model, keep=["doc_id"])
    return scored.select("row.doc_id", (F.coalesce(crc_fold("row.doc_id") == 2, F.lit(False))).alias("held_out"), "out.score", (F.col("out.score") >= quality_model.KEEP).cast("int").alias("predicted"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    path = tokenizer_path()
    found = chat_format.digests(chat_format.assemble(turns.unionByName(control), path), path)
    return found.withColumnRenamed("conversation", "conv_id")


def op9_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = lang_id.predict_languages(docs.select("doc_id", "text"), lang_id.fit_languages(docs), keep=["doc_id"])
    return found.select("row.doc_id", (F.coalesce(crc_fold("row.doc_id") == 2, F.lit(False))).alias("held_out"), "out.lang_pred", "out.score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), there=F.col("there"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (op1_decontaminate, op2_toxicity, op3_token_files, op4_url_filter, op5_quality_rules, op6_packing, op7_quality_model, op8_chat_format, op9_lang_id, op10_simhash, op11_lexical_search, op12_conversation_repair, op13_ngram_join)
}


# DuckDB SQL for the same rows, where SQL can state them: trained models, packing, token ids and seeded XXH64 have none.

_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = f"""WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, array_to_string(w[k : k + 12], ' ') AS x, least(len(w), 13) AS n FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
starts AS (SELECT DISTINCT n, split_part(x, ' ', 1) AS word FROM win),
spot AS (SELECT p.doc_id, p.k, s.n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d) p JOIN starts s USING (word)),
found AS (SELECT doc_id, item, k, n FROM (SELECT s.doc_id, s.k, s.n, array_to_string(d.w[s.k : s.k + s.n - 1], ' ') AS x FROM spot s JOIN d USING (doc_id)) JOIN win USING (x, n)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM found) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

_REJECTED = " OR ".join(f"({r.when})" for r in quality_rules.RULES).replace("\\\\p", "\\p").replace(", '')", ", '', 'g')").replace("replace(text, '!', '', 'g')", "replace(text, '!', '')")

_OP5 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
p AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, word AS a, lead(word, 1) OVER v AS b, lead(word, 2) OVER v AS c, k FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d) WINDOW v AS (PARTITION BY doc_id ORDER BY k)) WHERE c IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(k, k + 3)) AS j FROM p WHERE n > 1) GROUP BY 1),
s AS (SELECT doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR {_REJECTED}) AS kept FROM s"""

_OP8 = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '{CONTROL}'),
e AS (SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_start|><|im_sep|><|im_end|>') AS written FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(written)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_OP11 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
t AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), s),
m AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS impact FROM p JOIN t USING (term), s),
x AS (SELECT item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN m USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x) WHERE rank <= {lexical.TOP}"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_OP13 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT r, array_to_string(w[k : k + 4], ' ') AS gram FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
s AS (SELECT r, hash(list_sort(list(DISTINCT gram))) AS content, count(DISTINCT gram) AS n FROM g GROUP BY 1),
one AS (SELECT content, min(r) AS r, any_value(n) AS n FROM s GROUP BY 1),
u AS (SELECT DISTINCT r, gram FROM g JOIN one USING (r)),
link AS (SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.gram = b.gram AND a.r <> b.r JOIN one p ON p.r = a.r JOIN one q ON q.r = b.r GROUP BY a.r, b.r, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach AS (SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
c AS (SELECT r, least(r, coalesce((SELECT min(y) FROM reach WHERE reach.x = one.r), r)) AS root, content FROM one),
low AS (SELECT root, min(d.doc_id) AS component_id FROM d JOIN s USING (r) JOIN c USING (content) GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, CASE WHEN s.n > 0 THEN component_id ELSE d.doc_id END AS component_id FROM d LEFT JOIN s USING (r) LEFT JOIN c USING (content) LEFT JOIN low USING (root)"""

_OP12 = r"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[]), lambda k, i: xor(k >> 1, 3988292384::BIGINT * (k & 1))))) % 20 AS kind FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE kind <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM r),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o),
st(q, ins, nq) AS (VALUES (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
kp(q, i, nq) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
best AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, 0 AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM f
    UNION ALL SELECT conv_id, n, q, cost, audit, lines FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, n, q ORDER BY cost, audit) AS place FROM (
        SELECT m.conv_id, m.n, e.nq AS q, m.cost + e.cost AS cost, m.audit || e.letter AS audit, list_concat(m.lines, e.lines) AS lines
        FROM (SELECT b.conv_id, f.n, f.role, f.text, f.fault, f.i, x.q, b.cost + x.cost AS cost, b.audit || x.letter AS audit, list_concat(b.lines, x.lines) AS lines
            FROM best b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.n = b.n + 1, LATERAL (SELECT b.q AS q, 0 AS cost, '' AS letter, []::VARCHAR[] AS lines UNION ALL SELECT st.nq, 3, 'I', [CASE st.ins WHEN 'u' THEN 'user:' ELSE 'assistant:' END] FROM st WHERE st.q = b.q) x) m,
        LATERAL (SELECT m.q AS nq, 4 AS cost, 'D' AS letter, []::VARCHAR[] AS lines
            UNION ALL SELECT kp.nq, CASE WHEN m.fault = 'truncated' THEN 3 ELSE 0 END, 'K', [m.role || ':' || m.text] FROM kp WHERE kp.q = m.q AND kp.i = m.i AND m.fault NOT IN ('blank', 'duplicate')
            UNION ALL SELECT st.nq, CASE WHEN m.fault = 'truncated' THEN 6 ELSE 3 END, 'R', [CASE st.ins WHEN 'u' THEN 'user:' ELSE 'assistant:' END || m.text] FROM st WHERE st.q = m.q AND m.fault NOT IN ('blank', 'duplicate')) e)) WHERE place = 1),
c AS (SELECT conv_id, max(n) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
e AS (SELECT b.conv_id, b.cost + x.cost AS cost, b.audit || x.letter AS audit, list_concat(b.lines, x.lines) AS lines FROM best b JOIN c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.last = b.n JOIN (VALUES (0, 0, '', []::VARCHAR[]), (3, 0, '', []), (2, 3, 'I', ['assistant:']), (1, 6, 'II', ['user:', 'assistant:'])) x(q, cost, letter, lines) ON x.q = b.q),
w AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM a.conv_id"""

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": _OP1, "op5_quality_rules": _OP5, "op8_chat_format": _OP8, "op11_lexical_search": _OP11, "op12_conversation_repair": _OP12, "op13_ngram_join": _OP13}
