"""One query for each operator, over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from contagrid.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contagrid.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE["op9_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contagrid.llm.simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contagrid.llm.language_id import predicted

    return predicted(table(spark, sf_dir, "documents"))


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contagrid.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contagrid.llm.decontaminate import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op5_decontaminate"] = r"""
WITH words AS (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
    UNION ALL
    SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
    FROM benchmark
), places AS (
    SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5
), shingles AS (
    SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s FROM places
), sizes AS (
    SELECT id AS item_id, count(*) AS item_shingles FROM shingles WHERE kind = 'i' GROUP BY id
), hits AS (
    SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared
    FROM shingles d JOIN shingles i ON d.s = i.s
    WHERE d.kind = 'd' AND i.kind = 'i'
    GROUP BY d.id, i.id
)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles::DOUBLE AS containment
FROM hits JOIN sizes USING (item_id)
WHERE shared >= 0.8 * item_shingles
"""


@query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contagrid.llm.licenses import scan_licenses, summary

    return summary(scan_licenses(table(spark, sf_dir, "documents")))


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contagrid.llm.lm_scoring import scored

    return scored(table(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contagrid.llm.toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SURROGATE_KEY = b"contagrid corpus surrogates"


@query
def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: how much personal data of which kinds, and its text with surrogates, or as it was if there is none."""
    from contagrid.llm.pii import pseudonymise

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pseudonymise(docs, SURROGATE_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",")
    return found.select("doc_id", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"), "text")


@query
def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each revisit of six visits of every page, with the stored response it stands for."""
    from contagrid.llm.warc import crawl, resolve_revisits

    found = resolve_revisits(crawl(table(spark, sf_dir, "pages")))
    header = lambda name: F.element_at("headers", name).alias(name.replace("-", "_"))
    return found.select("record_id", "url_key", "outcome", "response_id", "digest", header("content-length"), header("date"))


ORACLE["op3_warc_revisits"] = r"""
WITH bare AS (
    SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(url), '#.*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u
    FROM pages
), parts AS (
    SELECT page_id, html, u,
           regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
           regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
           list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
                                 lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)', 'i'))) AS kept
    FROM bare
), pages_keyed AS (
    SELECT page_id, html, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key
    FROM parts
), visits AS (
    SELECT page_id, url_key, html, k, page_id * 6 + k AS record_id, page_id * 60 + k * 3600 AS second,
           CASE k WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN (page_id % 3 = 0)::INT WHEN 3 THEN (page_id % 3 = 0 AND page_id % 2 = 1)::INT ELSE (page_id % 3 <= 1)::INT END AS version
    FROM pages_keyed, range(6) AS numbers(k)
), captures AS (
    SELECT *, sha256(html || CASE version WHEN 1 THEN chr(10) ELSE '' END) AS body, 'version ' || version AS modified, second * 4294967296 + record_id AS place
    FROM visits
), responses AS (
    SELECT url_key, place, record_id, body, modified, CAST(strlen(html) + version AS VARCHAR) AS content_length
    FROM captures WHERE k % 2 = 0 AND (page_id + k) % 5 <> 0
), matched AS (
    SELECT v.record_id, v.url_key, 'visit ' || v.k AS date, r.record_id AS response_id, r.body, r.content_length,
           CASE (v.page_id + v.k) % 4 WHEN 0 THEN v.body = r.body WHEN 1 THEN v.body[1:16] = r.body[1:16] WHEN 2 THEN v.modified = r.modified END AS same
    FROM (SELECT * FROM captures WHERE k % 2 = 1) v ASOF LEFT JOIN responses r ON v.url_key = r.url_key AND v.place > r.place
), judged AS (
    SELECT *, CASE WHEN response_id IS NULL THEN 'missing' WHEN same IS NULL THEN 'unchecked' WHEN same THEN 'resolved' ELSE 'changed' END AS outcome
    FROM matched
)
SELECT record_id, url_key, outcome,
       CASE WHEN outcome IN ('resolved', 'unchecked') THEN response_id END AS response_id,
       CASE WHEN outcome IN ('resolved', 'unchecked') THEN body END AS digest,
       CASE WHEN outcome IN ('resolved', 'unchecked') THEN content_length END AS content_length,
       CASE WHEN outcome IN ('resolved', 'unchecked') THEN date END AS date
FROM judged
"""


@query
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contagrid.llm.secret_rules import BASE
    from contagrid.llm.secrets import scan_secrets, written_spans

    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(rule.kind) for rule in BASE],
        F.sha2(written_spans(base).cast("binary"), 256).alias("base_sha256"),
        written_spans(F.col("spans")).alias("spans"),
    )


def _secrets_sql() -> str:
    from contagrid.llm.secret_rules import BASE, RULES

    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    found = "\n    UNION ALL\n    ".join(
        f"SELECT row, {rank} AS rank, {quoted(rule.kind)} AS kind, {rule.shortest} AS shortest, string_split_regex(text, {quoted(rule.pattern)}) AS gaps, "
        f"regexp_extract_all(text, {quoted(rule.pattern)}, 0) AS whole, regexp_extract_all(text, {quoted(rule.pattern)}, {rule.group}) AS part FROM docs"
        for rank, rule in enumerate(RULES)
    )
    counts = ",\n       ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in BASE)
    counted = ", ".join(f"count(*) FILTER (kind = {quoted(rule.kind)}) AS n_{rule.kind}" for rule in BASE)
    return rf"""
WITH docs AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), found AS (
    {found}
), matches AS (
    SELECT row, rank, kind, shortest, i, length(gaps[i]) AS gap, length(whole[i]) AS size, length(part[i]) AS size_of_part
    FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM found)
), placed AS (
    SELECT *, CAST(sum(gap + size) OVER (PARTITION BY row, rank ORDER BY i) AS BIGINT) AS stop FROM matches
), spans AS (
    SELECT row, rank, kind, stop - size AS start, kind || ':' || (stop - size) || ':' || stop AS span FROM placed WHERE size_of_part >= shortest
), listed AS (
    SELECT row, {counted}, string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
    FROM spans GROUP BY row
)
SELECT doc_id,
       {counts},
       sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (row)
"""


ORACLE["op11_secrets"] = _secrets_sql()


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contagrid.llm.fill_in_middle import fill_in_middle, restored

    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE["op12_fill_in_middle"] = r"""
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
    FROM documents
), drawn AS (
    SELECT doc_id, text, u, len(u) AS n,
           CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
                WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM hashed
), parts AS (
    SELECT doc_id, text, n, form,
           array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
           array_to_string(u[greatest(c1, c2) + 1:n], '') AS s
    FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256
FROM parts
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's proof, and whether it holds for a copy in which some texts were lower-cased."""
    from contagrid.llm.common import ascii_lower, part_of
    from contagrid.llm.merkle import fold, hex_of, leaf_digest, proofs, siblings

    tampered = F.when(part_of("doc_id", 3) == 0, leaf_digest(text=ascii_lower(F.col("text"))))
    rows = proofs(table(spark, sf_dir, "documents"), tampered).withColumn("folded", fold(F.col("proof"), F.col("claimed")))
    digests = [hex_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return rows.select(
        "doc_id", *digests,
        F.sha2(siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == hex_of(F.col("root"))).alias("verified"),
    )


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


ORACLE["op13_merkle_manifest"] = rf"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t
), rows AS (
    SELECT row_number() OVER () AS row, doc_id, lang, {_leaf('text')} AS leaf, {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered,
           coalesce(CAST(doc_id AS VARCHAR), '') AS id
    FROM documents
), folds AS (
    SELECT row, doc_id, lang, leaf, lowered,
           xor(list_reduce([4294967295] || list_transform(string_split(id, ''), lambda c: ascii(c)), lambda a, c: xor(a // 256, t[xor(a % 256, c) + 1])), 4294967295) % 3 = 0 AND id <> '' OR id = '' AS altered
    FROM rows, crc_table
), leaves AS (
    SELECT row, doc_id, leaf, CASE WHEN altered THEN lowered ELSE leaf END AS claimed,
           dense_rank() OVER (ORDER BY lang NULLS FIRST) AS space,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS width
    FROM folds
), tree AS (
    SELECT space, 0 AS level, i, width, leaf AS h FROM leaves
    UNION ALL
    SELECT space, level + 1, i // 8, (any_value(width) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE width > 1 GROUP BY space, level, i // 8
), subroots AS (
    SELECT space, level AS height, h FROM tree WHERE width = 1
), top AS (
    SELECT 0 AS level, space - 1 AS i, (SELECT count(*) FROM subroots) AS width, h FROM subroots
    UNION ALL
    SELECT level + 1, i // 8, (any_value(width) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE width > 1 GROUP BY level, i // 8
), steps AS (
    SELECT row, t.level, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < l.i // CAST(pow(8, t.level) AS BIGINT)), '') AS before,
           coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > l.i // CAST(pow(8, t.level) AS BIGINT)), '') AS after
    FROM leaves l JOIN tree t ON t.space = l.space AND t.width > 1 AND t.i // 8 = l.i // CAST(pow(8, t.level + 1) AS BIGINT)
    GROUP BY row, t.level
    UNION ALL
    SELECT row, 1000 + t.level, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < (l.space - 1) // CAST(pow(8, t.level) AS BIGINT)), ''),
           coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > (l.space - 1) // CAST(pow(8, t.level) AS BIGINT)), '')
    FROM leaves l JOIN top t ON t.width > 1 AND t.i // 8 = (l.space - 1) // CAST(pow(8, t.level + 1) AS BIGINT)
    GROUP BY row, t.level
), paths AS (
    SELECT row, list(before || '|' || after ORDER BY level) AS path, string_agg(before || after, '' ORDER BY level) AS proof FROM steps GROUP BY row
), folded AS (
    SELECT l.*, coalesce(proof, '') AS proof, list_reduce([claimed] || coalesce(path, []), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
    FROM leaves l LEFT JOIN paths USING (row)
)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = r.h AS verified
FROM folded f JOIN subroots s USING (space), (SELECT h FROM top WHERE width = 1) r
"""
