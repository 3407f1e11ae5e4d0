"""The corpus queries: one per operator, with SQL where SQL can express the result."""

from __future__ import annotations

import corpus_pipeline
from cohortloom.llm import bpe, exact, langid, mixing, neighbours, ngram, packing, periods, simhash, spelling, suffixes, trees, warc
from cohortloom.llm.common import documents

ALL, SQL = {}, {}


def query(fn=None, sql: str | None = None):
    def add(f):
        ALL[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add(fn) if fn else add


@query(sql="""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op3_exact_dedup(spark, sf_dir):
    return exact.duplicates(documents(spark, sf_dir))


@query
def op6_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


@query
def op9_simhash(spark, sf_dir):
    return simhash.groups(documents(spark, sf_dir))


@query
def op10_bpe(spark, sf_dir):
    return bpe.encode_digests(documents(spark, sf_dir))


@query
def op4_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


@query
def op5_substring_dedup(spark, sf_dir):
    return trees.digests(documents(spark, sf_dir))


@query
def op8_suffix_dedup(spark, sf_dir):
    return suffixes.digests(documents(spark, sf_dir))


@query(sql="""
WITH records AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                        max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
FROM records""")
def op2_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op1_quality(spark, sf_dir):
    return ngram.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op7_embedding_dedup(spark, sf_dir):
    return neighbours.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op11_mixing(spark, sf_dir):
    return mixing.taken(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query(sql="""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, x:
                     CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS raw FROM documents),
runs AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM found GROUP BY 1, 2),
hashed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(key))),
                  lambda i: ('0x' || substr(hex(encode(key)), 2 * i + 1, 2))::BIGINT)),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
           FROM (SELECT run, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key FROM runs WHERE length(run) >= 6), bits),
worn AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM worn WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM places),
replaced AS (SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word),
shorter AS (SELECT DISTINCT h.word, h.n, w.word AS near, w.n AS near_n FROM holes h JOIN w ON w.word = h.less),
links AS (SELECT word, near, near_n FROM replaced UNION ALL SELECT word, near, near_n FROM shorter UNION ALL SELECT near, word, n FROM shorter),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM links GROUP BY word),
named AS (SELECT b.word, b.n_near, b.top, min(l.near) AS form FROM best b JOIN links l ON l.word = b.word AND l.near_n = b.top GROUP BY ALL),
known AS (SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.top >= 5 * w.n THEN m.form END AS form,
                 CASE WHEN m.top >= 5 * w.n THEN m.top END AS form_n FROM w LEFT JOIN named m ON m.word = w.word),
led AS (WITH RECURSIVE chain(word, root, step) AS (
          SELECT word, form, 1 FROM known WHERE form IS NOT NULL
          UNION ALL SELECT c.word, k.form, c.step + 1 FROM chain c JOIN known k ON k.word = c.root WHERE k.form IS NOT NULL)
        SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT k.word, k.form, coalesce(l.root, k.word) AS root, k.n, k.n_near, k.form_n FROM known k LEFT JOIN led l ON l.word = k.word""")
def op12_spelling(spark, sf_dir):
    return spelling.groups(documents(spark, sf_dir))


@query
def op13_periods(spark, sf_dir):
    return periods.digests(documents(spark, sf_dir))


ALL["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
