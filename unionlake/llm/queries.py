"""Queries of the operators, one for each, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from unionlake.llm import decontaminate, dictionary_clusters, line_dedup, near_dup, ngram_lm, packing, page_text, pii, pivot_codes, posting_search, quality, token_files, url_filter
from unionlake.session import prepare

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@query
def op1_dart_minhash(spark, table):
    """The near-duplicate class of every document."""
    return near_dup.near_classes(table("documents"))


@query
def op2_pfor_token_files(spark, table):
    """Every document as its token-ID file has it."""
    return token_files.read_token_files(token_files.write_token_files(table("documents"), public_tokenizers.path("byte_bpe_50k.json")))


#: The rules of the URL contract (fixed values).
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query
def op3_url_reputation(spark, table):
    """Rule and verdict of every page; labels are those of the documents with the pages' ids."""
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    labels = table("labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    judged = url_filter.judge(table("pages").select("page_id", "url"), labels, rules)
    return judged.select("page_id", "__url_verdict.host", "__url_verdict.path", "__url_verdict.rule", "__url_verdict.verdict")


@query
def op4_spaced_seed_leaks(spark, table):
    """Every document and benchmark item that leaked into it."""
    return decontaminate.leaks(table("documents"), table("benchmark"))


@query
def op5_page_differencing(spark, table):
    """The main text of every page."""
    return page_text.extract(table("pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op6_distribution_divergence(spark, table):
    """Base counts and verdict of every document."""
    docs = table("documents").select("doc_id", "text", "lang")
    rated, q = quality.rate(docs, quality.language_references(docs))
    return rated.select("doc_id", *[F.col(q)[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def packed_documents(docs: DataFrame) -> DataFrame:
    packed = packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
    return packed.select(F.col("doc").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


@query
def op7_certified_packing(spark, table):
    """The place of every piece of every document."""
    return packed_documents(table("documents"))


@query
def op8_kneser_ney(spark, table):
    """The score of every document, by a model of those that are not held out."""
    docs = table("documents").select("doc_id", "text", ngram_lm.held_out("doc_id").alias("held_out"))
    model = ngram_lm.train(docs.where("not held_out"))
    scored = ngram_lm.score(docs, model, keep=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.words.total).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op9_line_similarity_join(spark, table):
    """What is removed from every document."""
    return line_dedup.line_report(table("documents"))


@query
def op10_disclosure_sanitisation(spark, table):
    """Personal data and disclosing terms of every document."""
    found = pii.find(table("documents"))
    base = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    only_base = F.filter("spans", lambda s: s["kind_no"] < 4)
    return found.select(
        "doc_id", *[F.size(base(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS[:4]],
        F.sha2(pii.digest(only_base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


@query
def op11_subvector_dictionaries(spark, table):
    """The cluster of every embedding."""
    rows, centroids = dictionary_clusters.cluster(table("embeddings"))
    return dictionary_clusters.with_inertia(rows, centroids).withColumnRenamed("id", "vec_id")


@query
def op12_laesa_codes(spark, table):
    """The code of every embedding."""
    found = pivot_codes.compress(table("embeddings"))
    rows = pivot_codes.label_errors(found.rows)
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(pivot_codes.books_digest(found.books)).alias("codebooks_sha256"))


@query
def op13_balanced_posting_lists(spark, table):
    """The ten nearest neighbours of every hundredth embedding."""
    vectors = table("embeddings").select("vec_id", "embedding")
    index = posting_search.build_index(vectors)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return posting_search.search(index, vectors.where(F.col("vec_id") % 100 == 0))


ORACLES["op9_line_similarity_join"] = """
with raw as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 line_no from documents),
worded as (select * from (select doc_id, line_no, list_sort(list_distinct(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) ws from raw) where len(ws) > 0),
cls as (select ws, min(row(doc_id, line_no)) ord, row_number() over () id, len(ws) n from worded group by ws),
tok as (select id, n, unnest(ws) t from cls), df as (select t, count(*) d from tok group by t),
pre as (select * from (select id, n, tok.t, row_number() over (partition by id order by d, tok.t) r from tok join df using (t)) where r <= n - (4 * n + 4) // 5 + 1),
cand as (select distinct a.id x, b.id y from pre a join pre b on a.t = b.t and a.id < b.id and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n),
lk as (select case when a.ord < b.ord then b.id else a.id end id from cand join cls a on a.id = x join cls b on b.id = y where 9 * len(list_intersect(a.ws, b.ws)) >= 4 * (a.n + b.n)),
st as (select ord, ws, id in (select id from lk) near from cls),
marked as (select w.doc_id, line_no, near, ord = row(w.doc_id, line_no) as first from worded w join st using (ws)),
per as (select doc_id, count(*) n_lines, count(*) filter (where near or not first) n_removed, count(*) filter (where near and first) n_similar,
  string_agg(line_no::varchar, ',' order by line_no) filter (where near or not first) removed from marked group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_similar, 0)::bigint n_similar, coalesce(removed, '') removed from documents d left join per using (doc_id)
"""

ORACLES["op4_spaced_seed_leaks"] = """
with dt as (select doc_id, generate_subscripts(w, 1) - 1 p, unnest(w) t from (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w from documents)),
b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') w from benchmark),
bt as (select item_id, len(w) n, least(len(w), 13) width, generate_subscripts(w, 1) - 1 q, unnest(w) t from b),
-- every alignment of a document and an item by its equal tokens
al as (select doc_id, item_id, p - q shift, n, width, list(q) qs, count(*) k from dt join bt using (t) group by all having count(*) >= 0.8 * width),
ok as (select * from al where list_max(list_transform(range(n - width + 1), lambda s: len(list_filter(qs, lambda q: q >= s and q < s + width)))) >= 0.8 * width)
select doc_id, item_id, (min(row(-k, shift)))[2]::bigint token_at, max(k)::bigint n_same, any_value(n)::bigint n_item, count(*)::bigint n_places from ok group by 1, 2
"""


def _sql_strength(mean: str, groups: str, by: str = "") -> str:
    """The prior weight of the groups (n, bad) below each parent."""
    p, over = url_filter.ReputationParams(), f"any_value({mean}) * (1 - any_value({mean}))"
    beyond = f"greatest(sum(n * power(bad / n - {mean}, 2)) / sum(n) - {over} * count(*) / sum(n), 1e-9)"
    return f"select {by + ', ' if by else ''}least(greatest({over} / {beyond} - 1, {p.min_strength}), {p.max_strength}) s from {groups} where n > 0{' group by ' + by if by else ''}"


def _sql_op3() -> str:
    p = url_filter.ReputationParams()
    labels = "string_split(host, '.')"
    last = lambda k: f"array_to_string({labels}[greatest(len({labels}) - {k - 1}, 1):], '.')"
    two = "(" + ", ".join(f"'{x}'" for x in url_filter.TWO_LABEL_SUFFIXES) + ")"
    rules = ", ".join(f"('{r}', '{a}')" for r, a in URL_RULES)
    shrunk = lambda prior: f"(bad + {prior} * coalesce(s, {p.min_strength})) / (n + coalesce(s, {p.min_strength}))"
    return f"""
with pg as (select row_number() over () rid, page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') path from pages),
marks as (select doc_id page_id, max((quality = 0 or toxic = 1)::int) b from labels where (quality = 0 or toxic = 1) is not null group by 1),
h as (select host, {last(1)} one, {last(2)} two, {last(3)} three, count(b)::double n, coalesce(sum(b), 0)::double bad from pg left join marks using (page_id) group by host),
hosts as (select host, case when two in {two} then three else two end as domain, case when two in {two} then two else one end as suffix, n, bad from h),
m as (select (sum(bad) + 1) / (sum(n) + 2) m0 from hosts),
t0 as (select suffix, sum(n) n, sum(bad) bad, any_value(m0) m0 from hosts, m group by suffix),
t1 as (select suffix, {shrunk("m0")} m1 from t0 left join ({_sql_strength("m0", "t0")}) on true),
d0 as (select suffix, domain, sum(n) n, sum(bad) bad, any_value(m1) m1 from hosts join t1 using (suffix) group by all),
d1 as (select domain, {shrunk("m1")} m2 from d0 left join ({_sql_strength("m1", "d0", "suffix")}) using (suffix)),
h0 as (select host, domain, n, bad, m2 from hosts join d1 using (domain)),
h1 as (select host, n + coalesce(s, {p.min_strength}) w, {shrunk("m2")} mean from h0 left join ({_sql_strength("m2", "h0", "domain")}) using (domain)),
facts as (select host, mean - {p.z} * sqrt(mean * (1 - mean) / (w + 1)) low from h1),
rules as (select rule, action, split_part(rule, '/', 1) as at_host, substr(rule, instr(rule, '/')) start from (values {rules}) r(rule, action)),
fit as (select rid, rule, action from pg join rules on (host = at_host or ends_with(host, '.' || at_host)) and starts_with(path, start) qualify row_number() over (partition by rid order by length(rule) desc, length(at_host) desc, action <> 'block', rule) = 1)
select page_id, host, path, rule, coalesce(action, case when low > {p.limit} then 'block' else 'allow' end) verdict from pg left join facts using (host) left join fit using (rid)
"""


ORACLES["op3_url_reputation"] = _sql_op3()


def _sql_whole(scale: int, where: str) -> str:
    finite = "embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0"
    return f"select vec_id, label, list_transform(embedding, lambda v: floor({scale} * v::double)) v from embeddings where {finite}{where}"


def _sql_square(a: str, b: str) -> str:
    """Squared distance of two lists of whole numbers, exact in doubles."""
    return f"list_inner_product({a}, {a}) - 2 * list_inner_product({a}, {b}) + list_inner_product({b}, {b})"


def _sql_op11(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    ctes = [f"x as materialized ({_sql_whole(256, f' and len(embedding) = {dims}')})",
            f"c0 as materialized (select (row_number() over (order by sha256('2:' || vec_id)) - 1)::int c, v from x order by sha256('2:' || vec_id) limit {k})"]
    for r in range(rounds + 1):
        ctes.append(f"a{r} as materialized (select vec_id, any_value(x.v) v, min(row({_sql_square('x.v', 'm.v')}, c)) best from x, c{r} m group by vec_id)")
        ctes.append(f"n{r} as (select c, list(floor(s / n) order by d) v from (select best[2] c, d, sum(v[d]) s, count(*) n from a{r}, range(1, {dims + 1}) t(d) group by all) group by c)")
        ctes.append(f"c{r + 1} as materialized (select o.c, coalesce(n.v, o.v) v from c{r} o left join n{r} n using (c))")
    return f"""with {', '.join(ctes)}
select vec_id, best[2]::int as cluster, best[1]::bigint distance, (sum(best[1]) over (partition by best[2]))::bigint cluster_inertia, (sum(best[1]) over ())::bigint inertia,
  sha256(array_to_string(list_transform(m.v, lambda i: i::bigint), ',')) centroid_sha256 from a{rounds} join c{rounds} m on m.c = best[2]"""


def _sql_op12(entries: int = 16, rounds: int = 6, parts: int = 8, width: int = 8) -> str:
    ctes = [f"x as materialized ({_sql_whole(4096, '')})",
            f"p as materialized (select vec_id, label, j, v[j * {width} + 1 : j * {width} + {width}] v from x, range({parts}) t(j))",
            f"s as (select vec_id, row_number() over (order by vec_id) - 1 e from x order by vec_id limit {entries})",
            "b0 as materialized (select j, e, v from p join s using (vec_id))"]
    for r in range(rounds + 1):
        ctes.append(f"a{r} as materialized (select vec_id, p.j, any_value(label) label, any_value(p.v) v, min(row({_sql_square('p.v', 'b.v')}, e)) best from p join b{r} b on p.j = b.j group by vec_id, p.j)")
        ctes.append(f"n{r} as (select j, e, list(floor(s / n) order by d) v from (select j, best[2] e, d, sum(v[d]) s, count(*) n from a{r}, range(1, {width + 1}) t(d) group by all) group by j, e)")
        ctes.append(f"b{r + 1} as materialized (select o.j, o.e, coalesce(n.v, o.v) v from b{r} o left join n{r} n using (j, e))")
    return f"""with {', '.join(ctes)},
f as (select vec_id, any_value(label) label, string_agg(format('{{:02x}}', best[2]::int), '' order by j) code, sum(best[1])::bigint error from a{rounds} group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error,
  (select sha256(string_agg(array_to_string(list_transform(v, lambda i: i::bigint), ','), ',' order by j, e)) from b{rounds}) codebooks_sha256 from f"""


ORACLES["op11_subvector_dictionaries"] = _sql_op11()
ORACLES["op12_laesa_codes"] = _sql_op12()
