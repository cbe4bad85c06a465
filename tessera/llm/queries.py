"""Queries of the training-data problems that belong to this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import digests, leakage, overlap, packing, pii
from tessera.operators.bad_rows import loaded, parse_rows
from tessera.plans.data_queries import LINES
from tessera.util import cut, load

PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def _measures(spark, d) -> DataFrame:
    """w and h of the loadable lines and of the boxes, by class and day."""
    lines = loaded(parse_rows(load(spark, d, "label_lines").select("raw", "ingested_at"), load(spark, d, "classes")), ["ingested_at"])
    cols = ["table_name", "class_id", F.to_date("ingested_at").alias("day"), F.inline(F.array(F.struct(F.lit("w").alias("measure"), F.col("w").alias("value")), F.struct(F.lit("h").alias("measure"), F.col("h").alias("value"))))]
    lines = lines.withColumn("table_name", F.lit("label_lines")).select(*cols)
    boxes = load(spark, d, "boxes").where("class_id is not null").withColumn("table_name", F.lit("boxes")).select(*cols)
    return lines.unionByName(boxes)


def p3_percentiles(spark, d):
    rows = cut(_measures(spark, d))
    return digests.certified_percentiles(rows, ["table_name", "class_id", "measure"], "value", PERCENTILES, ["day"])[1]


def p3_within_bound(spark, d):
    return p3_percentiles(spark, d).select("table_name", "class_id", "measure", "q", "n", "within_bound")


def _pictures(spark, d):
    return overlap.scored_pictures(load(spark, d, "image_errors").select("error_id", "path"))


def p5_found(spark, d):
    return overlap.overlapping_pairs(_pictures(spark, d))


def p5_counts(spark, d):
    return overlap.overlap_counts(_pictures(spark, d))


def _contents(spark, d):
    sizes = load(spark, d, "documents").select("doc_id", packing.byte_tokens(F.col("text")).alias("size"))
    return packing.pack(sizes, load(spark, d, "pack_specs"))


def p6_found(spark, d):
    return packing.divided(_contents(spark, d))


def p6_contents(spark, d):
    return _contents(spark, d)


def p6_fill(spark, d):
    return packing.fill(_contents(spark, d))


def p6_checks(spark, d):
    return packing.checks(_contents(spark, d))


def p6_tokens(spark, d):
    return _contents(spark, d).groupBy("spec_id", "doc_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"), F.count("*").alias("pieces"))


def _spans(spark, d):
    return leakage.leaked_spans(load(spark, d, "documents").select("doc_id", "text"), load(spark, d, "eval_passages").select("item_id", "text"))


def p7_found(spark, d):
    return leakage.leaks(_spans(spark, d))


def p7_spans(spark, d):
    return _spans(spark, d)


#: Of the surrogates; a deployment sets its own.
KEY = "tessera"


def _people(spark, d):
    return load(spark, d, "documents").select("doc_id", "text"), load(spark, d, "name_list"), load(spark, d, "members")


def _surrogated(spark, d) -> DataFrame:
    return pii.with_surrogates(cut(pii.find_personal(*_people(spark, d))), KEY)


def p8_found(spark, d):
    """What has got its surrogate."""
    return _surrogated(spark, d).where("surrogate <> value").select("doc_id", "kind", "start_pos", "end_pos")


def p8_surrogates(spark, d):
    return _surrogated(spark, d)


def p8_redacted(spark, d):
    return pii.rewrite(*_people(spark, d), KEY)


def p8_clashes(spark, d):
    return pii.clashes(cut(_surrogated(spark, d)))


def p8_ids_and_mail(spark, d):
    """Identity numbers and addresses with an @ per document, as their placeholders tell."""
    r = p8_redacted(spark, d)
    n = lambda kind: F.regexp_count("redacted", F.lit(rf"\[{kind}\]")).cast("bigint")
    return r.select("doc_id", n("ID_NUMBER").alias("ids"), n("EMAIL").alias("mail"))


QUERIES = {f.__name__: f for f in (p3_percentiles, p3_within_bound, p5_found, p5_counts, p6_found, p6_contents, p6_fill, p6_checks, p6_tokens, p7_found, p7_spans, p8_found, p8_surrogates, p8_redacted, p8_clashes, p8_ids_and_mail)}

_PICTURES = r"""
p as (select error_id, regexp_replace(replace(path, '\', '/'), '(/+([.]/+)*)', '/', 'g') path from image_errors),
n as (select error_id, string_split(path, '/')[4] source, lower(string_split(path, '/')[6]) s, regexp_replace(lower(string_split(path, '/')[-1]), '%[0-9a-f]{2}', ' ', 'g') name from p where path like '/mnt/aug/%'),
k as (select *, regexp_extract(name, '(?:^|[^a-z])([a-z]{3})[^a-z0-9]*c(?:am)?[^a-z0-9]*([0-9]{1,3})[^a-z0-9]+([0-9]{4})[^a-z0-9]?([0-9]{2})[^a-z0-9]?([0-9]{2})[^a-z0-9]+([0-9]+)', ['site', 'cam', 'y', 'm', 'd', 'frame']) r from n),
pictures as (select error_id, source, case when s in ('val', 'validation') then 'valid' else s end split, (r.site, cast(r.cam as int), r.y || r.m || r.d, cast(r.frame as hugeint)) as key from k where r.site <> '' and s in ('train', 'val', 'valid', 'validation', 'test'))"""

#: Every run of 15 words of documents (ds) and items (it), without shingles.
_WINDOWS = r"""b as (select doc_id, text t from documents where text is not null union all select doc_id, regexp_replace(t, '\([^()\[\]]*\)|\[[^()\[\]]*\]', ' ', 'g') from b where regexp_matches(t, '\([^()\[\]]*\)|\[[^()\[\]]*\]')),
  c as (select doc_id, t from b where not regexp_matches(t, '\([^()\[\]]*\)|\[[^()\[\]]*\]')),
  dw as (select doc_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') w from c), iw as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from eval_passages),
  ds as (select doc_id, i, array_to_string(w[i : i + 14], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 13)) i from dw)), it as (select item_id, i, array_to_string(w[i : i + 14], ' ') s from (select item_id, w, unnest(range(1, len(w) - 13)) i from iw))"""

ORACLE = {
    "p3_within_bound": f"""with {LINES},
      vals as (select 'label_lines' table_name, cast(id as int) class_id, c[3] w, c[4] h from parsed where reason is null union all select 'boxes', class_id, w, h from boxes where class_id is not null),
      per as (select table_name, class_id, measure, count(*) n from (select table_name, class_id, 'w' measure, w v from vals union all select table_name, class_id, 'h', h from vals) where isfinite(v) group by all)
      select table_name, class_id, measure, q, n, true within_bound from per, (values (0.05::double), (0.25::double), (0.5::double), (0.75::double), (0.95::double)) s(q)""",
    "p5_found": f"with {_PICTURES} select least(a.error_id, b.error_id) error_id_a, greatest(a.error_id, b.error_id) error_id_b from pictures a join pictures b using (key) where a.split = 'train' and b.split <> 'train'",
    "p5_counts": f"with {_PICTURES} select b.split, b.source, a.source train_source, count(*) pairs, count(distinct key) pictures from pictures a join pictures b using (key) where a.split = 'train' and b.split <> 'train' group by all",
    "p6_found": "select spec_id, doc_id from documents, pack_specs where strlen(text) + 1 > capacity",
    "p6_checks": "select spec_id, cast(sum(ceil((strlen(text) + 1) / capacity)) as bigint) pieces, cast(sum(strlen(text) + 1) as bigint) tokens, 0::bigint overfull, 0::bigint short from documents, pack_specs where text is not null group by 1",
    "p6_tokens": "select spec_id, doc_id, strlen(text) + 1 tokens, cast(ceil((strlen(text) + 1) / capacity) as bigint) pieces from documents, pack_specs where text is not null",
    "p8_clashes": "select '' as kind, '' as value where false",
    "p8_ids_and_mail": r"""select doc_id, len(regexp_extract_all(text, '(?:^[ ./-]?|[^\p{L}\p{N}_+ ./-]|[^\p{N}][ ./-])[0-9](?:[ ./-]?[0-9]){8}(?:[./-]?[A-Za-z]| [A-Z])(?:$|[^\p{L}\p{N}_])')) ids,
      len(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@| ?[(\[{] ?(?:at|AT|arobase) ?[)\]}] ?| (?:at|AT|arobase) )[A-Za-z0-9][A-Za-z0-9-]*(?:(?:\.| ?[(\[{] ?(?:dot|DOT|point) ?[)\]}] ?| (?:dot|DOT|point) )[A-Za-z0-9][A-Za-z0-9-]*)+')) mail from documents where text is not null""",
    "p7_found": rf"with recursive {_WINDOWS} select distinct doc_id, item_id from ds join it using (s)",
    "p7_spans": rf"""with recursive {_WINDOWS}, m as (select distinct doc_id, item_id, ds.i, ds.i - it.i shift from ds join it using (s)), r as (select *, i - row_number() over (partition by doc_id, item_id, shift order by i) run from m)
      select doc_id, item_id, cast(min(i) - 1 as int) word_start, cast(count(*) + 14 as int) n_words from r group by doc_id, item_id, shift, run""",
}
