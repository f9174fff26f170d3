"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparselin.llm import alignment, decontaminate, jaccard_join, line_dedup, near_dup, packing, quality, runs, substring_dedup, token_files, toxicity, urls, warc
from sparselin.llm.store import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@query("op1_token_files")
def op1(spark, sf):
    """Ids of all documents, written to Simple-8b files and read back."""
    scratch = Scratch(spark, "tokens")
    folder = scratch.path("files")
    manifest = scratch.table(
        token_files.write_tokens(documents(spark, sf), folder, "word_bpe_49k.json", end_id=1), "manifest")
    return token_files.read_tokens(spark, folder, manifest, token_files.digest, token_files.DIGEST)


@query("op5_best_fit_packing")
def op5(spark, sf):
    """Sequences of at most 1,024 tokens from all documents."""
    pieces = token_files.piece_table(documents(spark, sf), "byte_bpe_50k.json", end_id=2, size=1024)
    return packing.pack(pieces, 1024)


QUALITY_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
     w as (select doc_id, text,
                  list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
                  string_split(text, chr(10)) as lines,
                  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as filled
           from t),
     grams as (select doc_id, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
               from (select doc_id, words, unnest(generate_series(1, len(words) - 2)) as i from w)),
     found as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from grams),
     covered as (select doc_id, count(distinct p) as n from (
                   select doc_id, unnest([i, i + 1, i + 2]) as p from found where n > 1) group by doc_id),
     counts as (
       select doc_id, len(words) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
              length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
              len(filled) - len(list_distinct(filled)) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words,
              len(filled) as n_lines,
              len(list_filter(words, lambda x: lower(x) in (STOP))) as n_stop_words,
              len(list_filter(filled, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) as n_bullet_lines,
              len(list_filter(filled, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) as n_ellipsis_lines
       from w left join covered using (doc_id)),
     judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts)
select *, not base_failed and n_words <= 1000000 and word_chars / n_words between 2 and 14 and n_symbols / n_words <= 0.1
          and n_stop_words >= 2 and n_dup_lines / n_lines <= 0.5 and n_bullet_lines / n_lines <= 0.9
          and n_ellipsis_lines / n_lines <= 0.5 as kept
from judged
""".replace("STOP", ", ".join(f"'{w}'" for w in sorted({w for words in quality.STOP_WORDS.values() for w in words})))


@query("op6_quality_rules", QUALITY_SQL)
def op6(spark, sf):
    """Counts and verdicts of all documents."""
    return quality.judge(documents(spark, sf))


@query("op4_toxicity")
def op4(spark, sf):
    """Scores of all documents by a model of the labelled ones that are not held out."""
    docs = documents(spark, sf)
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/")]


@query("op8_url_filter")
def op8(spark, sf):
    """Verdicts on the urls of all pages."""
    return urls.judge(spark.read.parquet(f"{sf}/pages.parquet"), URL_RULES)


WARC_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
     d as (select page_id, octet_length(body) as payload_bytes, sha256(body) as payload_digest from p),
     f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest)
                     else page_id end as first from d)
select page_id, payload_bytes, payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type,
       case when first = page_id then null else first end as refers_to
from f
"""


@query("op10_warc", WARC_SQL)
def op10(spark, sf):
    """Archives of all pages, read back."""
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    manifest = scratch.table(warc.write_warc(spark.read.parquet(f"{sf}/pages.parquet"), folder), "manifest")
    return warc.read_warc(spark, folder, manifest)


LINES_SQL = r"""
with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
     l as (select doc_id, unnest(lines) as line, unnest(generate_series(1, len(lines))) as i from t),
     k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
     m as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
     j as (select k.*, m.first is not null and m.first <> doc_id as gone from k left join m using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from j group by doc_id
"""


@query("op7_line_dedup", LINES_SQL)
def op7(spark, sf):
    """Lines of all documents without those of smaller documents."""
    kept = line_dedup.drop_repeated_lines(documents(spark, sf).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


WINDOWS_SQL = r"""
with t as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
     w as (select doc_id, i, list_aggregate(words[i:i + 34], 'string_agg', ' ') as gram
           from (select doc_id, words, unnest(generate_series(1, len(words) - 34)) as i from t)),
     r as (select doc_id, i from (select *, count(*) over (partition by gram) as n from w) where n > 1),
     gone as (select distinct doc_id, unnest(generate_series(i, i + 34)) as p from r),
     g as (select doc_id, list(p) as ps from gone group by doc_id),
     p as (select doc_id, unnest(words) as word, unnest(generate_series(1, len(words))) as p from t),
     k as (select p.*, gone.p is not null as gone from p left join gone using (doc_id, p))
select t.doc_id, len(words) as n_words, coalesce(len(g.ps), 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from t left join g using (doc_id)
left join (select doc_id, string_agg(word, ' ' order by p) filter (not gone) as text from k group by doc_id) kept using (doc_id)
"""


@query("op9_substring_dedup", WINDOWS_SQL)
def op9(spark, sf):
    """Words of all documents without repeated passages."""
    kept = substring_dedup.remove_repeated(documents(spark, sf).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


NEAR_SQL = r"""
with recursive t as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
     s as (select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] end as g
           from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) as i from t where len(w) > 0)),
     n as (select doc_id, count(*) as n from s group by doc_id),
     p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
     l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
     e as materialized (select a, b from l union all select b, a from l),
     r as (select doc_id as d, doc_id as m from n union select e.a, r.m from r join e on e.b = r.d and r.m < e.a)
select t.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(q.m, t.doc_id) as component_id, coalesce(q.m, t.doc_id) = t.doc_id as kept
from t left join n using (doc_id) left join (select d as doc_id, min(m) as m from r group by d) q using (doc_id)
"""


@query("op3_near_duplicates", NEAR_SQL)
def op3(spark, sf):
    """Classes of near-duplicates among all documents, on three-word shingles at 0.85."""
    return near_dup.near_duplicates(documents(spark, sf), shingle=3, percent=85)


JACCARD_SQL = NEAR_SQL.replace("100 * c >= 85 *", "100 * c >= 90 *").replace(", coalesce(q.m, t.doc_id) = t.doc_id as kept", "")


@query("op11_jaccard_join", JACCARD_SQL)
def op11(spark, sf):
    """Components of all documents that are linked by three-word shingles at 0.90."""
    return jaccard_join.join_similar(documents(spark, sf), shingle=3, percent=90)


@query("op2_decontamination")
def op2(spark, sf):
    """Every benchmark item in every document, by word edits."""
    return decontaminate.find(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


# The word numbers are 1-based here. Five-word stretches that recur q words on join; consecutive ones are an island.
RUNS_SQL = r"""
with tab as (select list(v order by n) as t from (
         select n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
         from range(256) r(n))),
     h as (select doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
                                          lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) as h from documents, tab),
     w as (select doc_id, h, h // 10 as g, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
           from documents left join h using (doc_id)),
     a as (select doc_id, h, w, g, len(w) as n, case when len(w) > 0 then g % len(w) else 0 end as a from w),
     p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
     t as (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % p end])
                                  else w end as w from p),
     grams as (select doc_id, n, i, hash(w[i:i + 4]) as gram from (select doc_id, n, w, unnest(range(1, n - 3)) as i from t where n >= 6)),
     pairs as (select x.doc_id, y.i - x.i as q, x.i from grams x join grams y on x.doc_id = y.doc_id and x.gram = y.gram
               and y.i > x.i and 4 * (y.i - x.i) <= x.n),
     islands as (select doc_id, q, min(i) - 1 as s, count(*) + 4 + q as len
                 from (select *, i - row_number() over (partition by doc_id, q order by i) as k from pairs) group by doc_id, q, k),
     runs as (select doc_id, s, len, min(q) as q from islands where len >= greatest(6, 4 * q) group by doc_id, s, len),
     marked as (select doc_id, unnest(range(s + q, s + len)) as i from runs),
     gone as (select doc_id, list(distinct i) as gone from marked group by doc_id),
     kept as (select doc_id, array_to_string(list_transform(list_filter(range(n), lambda i: not list_contains(gone, i)), lambda i: w[i + 1]), ' ') as text
              from t join gone using (doc_id)),
     told as (select doc_id, count(*) as n_runs, min(struct_pack(l := -len, s := s, q := q)) as best,
                     string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as told from runs group by doc_id)
select doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, -best.l as length, best.q as period, (1000 * -best.l) // best.q as exponent_milli,
       sha256(coalesce(told, '')) as runs_sha256, sha256(coalesce(kept.text, array_to_string(t.w, ' '))) as collapsed_sha256
from t left join told using (doc_id) left join kept using (doc_id)
"""


@query("op12_periodic_runs", RUNS_SQL)
def op12(spark, sf):
    """Periodic runs of words in all documents, a tenth of which get a planted period."""
    docs = runs.with_periodic_tails(documents(spark, sf).select("doc_id", "text"))
    return runs.digest(runs.find_runs(docs))


@query("op13_token_alignment")
def op13(spark, sf):
    """Two tokenizations of all documents, aligned by byte offsets."""
    return alignment.align_and_count(documents(spark, sf)).drop("row")
