"""The registered queries of the operators, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import chosen_path, exact_dedup, language_id, line_dedup, mixing, ngram_join, packing, prefix_trie, quality_rules, secret_scan, suffix_dedup, url_filters, vector_codes


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the row that stays for its text, lower-cased A-Z."""
    found = exact_dedup.exact_dedup(_documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing every repeated string of 200 bytes does to each document."""
    found = suffix_dedup.repeated_spans(_documents(spark, sf_dir), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows outside the held-out quarter."""
    docs = _documents(spark, sf_dir).withColumn(
        "held_out", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    )
    # a null id has no remainder, so its row is neither learned from nor held out
    model = language_id.fit(docs.where(~F.col("held_out")).select("text", "lang"))
    found = language_id.predict(docs, model)
    return found.select(
        "doc_id",
        F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)).alias("held_out"),
        "lang_pred", "score", "ambiguous",
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, the base rules, and the verdict on repetition for every document."""
    found = quality_rules.quality_rules(_documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_covered_words",
    )


#: A repeat of 8 words or more is a chain of repeated 8-word windows, so these cover the same words; one
#: of over 200 words has a repeated window of 201.
OP5_SQL = r"""
with d as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, '[^ \t\n\x0B\f\r]+') as ws from d),
i as (select r, ws, unnest(range(1, len(ws) + 1)) as i from w),
g as (select r, i, len(ws) as n, case when i + 2 <= len(ws) then hash(ws[i:i + 2]) end as a, case when i + 7 <= len(ws) then hash(ws[i:i + 7]) end as b,
             case when i + 200 <= len(ws) then hash(ws[i:i + 200]) end as c from i),
k as (select r, i, a is not null and count(*) over (partition by r, a) > 1 as a, b is not null and count(*) over (partition by r, b) > 1 as b,
             c is not null and count(*) over (partition by r, c) > 1 as c from g),
m as (select r, count(*) filter (bool_or_a) as n_repeat_words, count(*) filter (bool_or_b) as n_covered_words, bool_or(c) as too_long
      from (select r, c, bool_or(a) over (partition by r order by i rows between 2 preceding and current row) as bool_or_a,
                   bool_or(b) over (partition by r order by i rows between 7 preceding and current row) as bool_or_b from k) group by r),
l as (select r, count(*) - count(distinct x) as n_dup_lines from (select r, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^ \t\n\x0B\f\r]') group by r),
j as (select d.doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
             coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_covered_words, 0) as n_covered_words, coalesce(too_long, false) as too_long
      from d join w using (r) left join m using (r) left join l using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 4 * n_covered_words > n_words or too_long) as kept, n_covered_words
from j
"""


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under Jaccard 0.85 on sets of 4-word shingles."""
    found = ngram_join.ngram_join(_documents(spark, sf_dir), k=4, threshold=(85, 100))
    return found.select("doc_id", "n_shingles", "component_id")


URL_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning rule and verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filters.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)


OP7_SQL = """
with p as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path
  from pages
), r as (
  select *, split_part(rule, '/', 1) as r_host, substr(rule, strpos(rule, '/')) as r_path
  from (values ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')) t(rule, v)
), best as (
  select page_id, host, path, arg_max(rule, length(rule)) as rule, arg_max(v, length(rule)) as v
  from p left join r on (host = r_host or suffix(host, '.' || r_host)) and starts_with(path, r_path)
  group by page_id, host, path
)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from best
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: which lines repeat, or nearly repeat, an earlier line of the corpus, and a
    digest of what stays (of an empty string if nothing does)."""
    found, _ = line_dedup.line_dedup(_documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_lines", "n_removed", "n_chars_removed",
        F.concat_ws(",", F.transform("removed_lines", lambda x: x.cast("string"))).alias("removed_lines"),
        F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP8_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
l as (select doc_id, unnest(range(len(x))) as n, unnest(x) as line from (select doc_id, string_split(t, chr(10)) as x from d)),
o as (select line, min({'d': doc_id, 'n': n}) as spot, list_distinct(list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) as ws from l
      where regexp_matches(line, '[^ \t\n\x0B\f\r]') group by line),
u as (select row_number() over (order by spot) as k, line, ws, len(ws) as m from o),
w as (select k, m, unnest(ws) as w from u),
f as (select w, count(*) as c from w group by w),
p as (select k, m, w, row_number() over (partition by k order by c, w) as pos from w join f using (w)),
q as (select * from p where pos <= m - (4 * m + 4) // 5 + 1),
pairs as (select distinct a.k as a, b.k as b from q a join q b on a.w = b.w and a.k < b.k and 5 * least(a.m, b.m) >= 4 * greatest(a.m, b.m)),
late as (select distinct b as k from pairs join u x on a = x.k join u y on b = y.k where 9 * len(list_intersect(x.ws, y.ws)) >= 4 * (x.m + y.m)),
g as (select l.doc_id, l.n, l.line, coalesce(late.k is not null or o.spot <> {'d': l.doc_id, 'n': l.n}, false) as gone
      from l left join o using (line) left join u using (line) left join late using (k))
select doc_id, count(*)::int as n_lines, count(*) filter (gone)::int as n_removed, coalesce(sum(length(line)) filter (gone), 0)::bigint as n_chars_removed,
       coalesce(string_agg(n::varchar, ',' order by n) filter (gone), '') as removed_lines,
       sha256(coalesce(string_agg(line, chr(10) order by n) filter (not gone), '')) as kept_sha256
from g group by doc_id
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    found = mixing.taken_of(*mixing.mix_sources(_documents(spark, sf_dir)))
    return found.select("doc_id", "size", "source_size", "target", "taken", "n_pieces", "n_shards")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base counts and digest, and all spans."""
    import public_tokenizers

    found = secret_scan.find_secrets(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every vector after two rounds of 64 entries in 16 parts."""
    return vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def _op11_sql() -> str:
    """Plain Lloyd rounds: every distance of every part and entry."""
    nearest = "select vec_id, part, x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) as m from p join {book} using (part) group by vec_id, part, x"
    moved = """
b{i} as (
  select part, e, coalesce(y, c) as c from {last} left join (
    select part, e, list(y order by k) as y from (
      select part, e, k, floor(sum(x[k]) / count(*))::bigint as y from (select part, m.e as e, x, unnest(range(1, len(x) + 1)) as k from a{i}) group by part, e, k
    ) group by part, e
  ) using (part, e)
)"""
    return f"""
with v as (
  select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), p as (
  select vec_id, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] as x from v, range(16) t(part)
), b0 as (
  select part, row_number() over (partition by part order by vec_id) - 1 as e, x as c from p where vec_id in (select vec_id from v order by vec_id limit 64)
), a1 as ({nearest.format(book="b0")}), {moved.format(i=1, last="b0")},
a2 as ({nearest.format(book="b1")}), {moved.format(i=2, last="b1")},
a3 as ({nearest.format(book="b2")}),
coded as (
  select vec_id, string_agg(printf('%02x', m.e), '' order by part) as code, sum(m.d)::bigint as error from a3 group by vec_id
), told as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, e)) as codebooks_sha256 from b2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join v using (vec_id), told
"""


def op12_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under Jaccard 0.8 on sets of 2-word shingles."""
    return chosen_path.chosen_path_join(_documents(spark, sf_dir), k=2, threshold=(80, 100))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt with the first turns of its hundred's first."""
    paths = prefix_trie.paths_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_heads(paths))


#: CRC-32 bit by bit; nodes by all prefixes of all rebuilt conversations.
OP13_SQL = """
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as p, {'r': coalesce(role, ''), 't': coalesce(text, '')} as x
  from conversations where conv_id is not null
), c as (
  select distinct conv_id, conv_id - conv_id % 100 as base,
         xor(list_reduce(flatten(list_transform(string_split(conv_id::varchar, ''), lambda s: [ascii(s)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
             lambda a, b: case when b >= 0 then xor(a, b) when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, 4294967295::bigint), 4294967295) % 6 as h
  from t
), s as (
  select c.conv_id, h, t.p, 0 as part, x from c join t on t.conv_id = c.base and t.p < h
  union all select c.conv_id, h, t.p, 1, x from c join t on t.conv_id = c.conv_id and t.p >= h
), q as (
  select c.conv_id, coalesce(list(x order by part, p) filter (x is not null), []) as xs from c left join s using (conv_id) group by c.conv_id
), m as (
  select conv_id, len(xs) as n, unnest(range(len(xs) + 1)) as d, xs from q
), k as (select conv_id, n, d, xs[1:d] as k, case when d > 0 then length(xs[d].t) else 0 end as own from m
), node as (
  select k, d, min(conv_id) as conv_id, count(*) as n, any_value(own) as own, count(*) filter (n > d) = 0 as leaf,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) as ends_sha256 from k group by k, d
), child as (select k[1:d - 1] as k, count(*) as kids from node where d > 0 group by all
), below as (
  select a.k, sum(leaf::int) as leaves, sum((n - 1) * own) as saved
  from (select k[1:a] as k, leaf, n, own from (select *, unnest(range(d + 1)) as a from node)) a group by a.k
)
select x.conv_id, x.d as depth, y.conv_id as parent_conv_id, x.n as n_convs, coalesce(kids, 0) as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens, x.ends_sha256
from node x join below using (k) left join child using (k) left join node y on x.d > 0 and y.k = x.k[1:x.d - 1]
"""


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_language_id": op3_language_id,
        "op4_packing": op4_packing,
        "op5_quality_rules": op5_quality_rules,
        "op6_ngram_join": op6_ngram_join,
        "op7_url_filters": op7_url_filters,
        "op8_line_dedup": op8_line_dedup,
        "op9_mixing": op9_mixing,
        "op10_secret_scan": op10_secret_scan,
        "op11_vector_codes": op11_vector_codes,
        "op12_chosen_path": op12_chosen_path,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op5_quality_rules": OP5_SQL, "op7_url_filters": OP7_SQL, "op8_line_dedup": OP8_SQL, "op11_vector_codes": _op11_sql(), "op13_prefix_trie": OP13_SQL}
