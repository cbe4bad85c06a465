"""Queries of the general data problems: unparsable rows, small files, hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.bad_rows import loaded, parse_rows, rejected
from tessera.operators.compaction import consolidate, deliveries, repeated_deliveries, same_deliveries, sorted_runs
from tessera.operators.selection import dominant_values, exact_quantiles
from tessera.util import cut, load


def _parsed(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return parse_rows(load(spark, d, "label_lines").select(*keep, "raw"), load(spark, d, "classes"))


def p1_found(spark, d):
    """Each of them has been through the field prefixes, up to its first broken field."""
    return rejected(_parsed(spark, d, "line_id"), ["line_id"]).where("field is not null").select("line_id", "reason")


def p1_broken_fields(spark, d):
    return rejected(_parsed(spark, d, "line_id"), ["line_id"]).groupBy("reason", "field").agg(F.count("*").alias("n"))


def p1_loaded(spark, d):
    return loaded(_parsed(spark, d, "line_id"), ["line_id"])


def p2_found(spark, d):
    lines = load(spark, d, "label_lines")
    runs = cut(sorted_runs(lines, keep_lines=False))
    met = cut(deliveries(runs, load(spark, d, "label_files").select("file_id", "image_key")))
    return repeated_deliveries(cut(same_deliveries(met, lines)))


def _consolidated(spark, d):
    return consolidate(load(spark, d, "label_lines"), load(spark, d, "label_files").select("file_id", "image_key"))


def p2_consolidated(spark, d):
    return _consolidated(spark, d)[0].select("file_id", F.inline("lines")).select("file_id", "line_idx", "line_id", "raw")


def p2_files(spark, d):
    return _consolidated(spark, d)[1].select("file_id", "image_key", "n_lines", "n_bytes", "same_as")


def p2_outputs(spark, d):
    return _consolidated(spark, d)[2]


def _class_values(spark, d) -> DataFrame:
    lines = loaded(_parsed(spark, d), []).select(F.lit("label_lines").alias("table_name"), "class_id", "w")
    boxes = load(spark, d, "boxes").where("class_id is not null").select(F.lit("boxes").alias("table_name"), "class_id", "w")
    return lines.unionByName(boxes)


def p4_found(spark, d):
    found = dominant_values(_class_values(spark, d).drop("w"), ["table_name"], "class_id")
    return found.select("table_name", F.col("class_id").cast("int").alias("class_id"))


def p4_class_quantiles(spark, d):
    return exact_quantiles(_class_values(spark, d), ["table_name", "class_id"], "w", [0.05, 0.25, 0.5, 0.75, 0.95])


QUERIES = {f.__name__: f for f in (p1_found, p1_broken_fields, p1_loaded, p2_found, p2_consolidated, p2_files, p2_outputs, p4_found, p4_class_quantiles)}

_BLANKS = "' ' || chr(9) || chr(13)"
_NUMBER = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
#: Every line with its fields, by rules of its own: quotes are checked and hidden, then fields counted and cast.
LINES = f"""
t as (select *, trim(coalesce(raw, ''), {_BLANKS}) s from label_lines),
u as (select *, regexp_replace(s, '(^|[ \t])"([^"]|"")*"([ \t]|$)', '\\1Q\\3', 'g') u1 from t),
v as (select *, regexp_replace(u1, '(^|[ \t])"([^"]|"")*"([ \t]|$)', '\\1Q\\3', 'g') u2 from u),
x as (select *, regexp_split_to_array(u2, '[ \t]+') f, regexp_split_to_array(s, '[ \t]+') g from v),
y as (select *, contains(u2, '"') or contains(array_to_string(g[1:5], ' '), '"') q, len(f) n,
  case when regexp_full_match(g[1], '[0-9]+') then try_cast(g[1] as bigint) end id,
  list_transform(g[2:5], lambda z: case when regexp_full_match(z, '{_NUMBER}') and isfinite(try_cast(z as double)) then try_cast(z as double) end) c from x where s <> ''),
parsed as (select *, case when q then 'quoting' when n < 5 or n > 7 then 'columns'
  when id is null or id not in (select class_id from classes where class_id is not null) or len(list_filter(c, lambda z: z is null)) > 0 or c[3] <= 0 or c[3] > 1 or c[4] <= 0 or c[4] > 1 then 'value' end reason from y)"""
#: Files by their whole normalised text instead of digests.
_FILES = """
l as (select file_id, count(*) n_lines, sum(strlen(coalesce(raw, '')) + 1) n_bytes,
  string_agg(trim(regexp_replace(raw, '[ \t\r]+', ' ', 'g'), ' '), chr(10) order by line_idx) filter (trim(regexp_replace(raw, '[ \t\r]+', ' ', 'g'), ' ') <> '') body from label_lines group by file_id),
f as (select file_id, image_key, coalesce(l.n_lines, 0) n_lines, coalesce(l.n_bytes, 0) n_bytes, body, case when body is not null then min(file_id) over (partition by image_key, body) end same_as from label_files left join l using (file_id))"""
_VALUES = f"""{LINES},
vals as (select 'label_lines' table_name, cast(id as int) class_id, c[3] w from parsed where reason is null union all select 'boxes', class_id, w from boxes where class_id is not null)"""

ORACLE = {
    "p1_found": f"with {LINES} select line_id, reason from parsed where reason is not null",
    "p1_broken_fields": f"""with {LINES}, f as (select reason, case when id is null or id not in (select class_id from classes where class_id is not null) then 'class_id' when c[1] is null then 'xc' when c[2] is null then 'yc'
      when c[3] is null or c[3] <= 0 or c[3] > 1 then 'w' when c[4] is null or c[4] <= 0 or c[4] > 1 then 'h' else 'extras' end field from parsed where reason is not null) select reason, field, count(*) n from f group by all""",
    "p1_loaded": f"with {LINES} select line_id, cast(id as int) class_id, c[1] xc, c[2] yc, c[3] w, c[4] h from parsed where reason is null",
    "p2_found": f"with {_FILES} select a.file_id file_id_a, b.file_id file_id_b from f a join f b on a.image_key = b.image_key and a.body = b.body and a.file_id < b.file_id",
    "p2_consolidated": f"with {_FILES} select file_id, line_idx, line_id, raw from label_lines where file_id not in (select file_id from f where same_as <> file_id)",
    "p2_files": f"with {_FILES} select file_id, image_key, cast(n_lines as bigint) n_lines, cast(n_bytes as bigint) n_bytes, same_as from f",
    "p2_outputs": f"""with {_FILES},
      e as (select file_id, min(line_idx) first_line, max(line_idx) last_line from label_lines group by 1),
      k as (select *, sum(n_bytes) over (order by file_id) - n_bytes start from f join e using (file_id) where n_lines > 0 and (same_as is null or same_as = file_id))
      select cast(row_number() over (order by start // 134217728) - 1 as int) out_no, min(file_id) low_file, arg_min(first_line, file_id) low_line, max(file_id) high_file, arg_max(last_line, file_id) high_line, count(*) n_files, cast(sum(n_lines) as bigint) n_lines, cast(sum(n_bytes) as bigint) n_bytes from k group by start // 134217728""",
    "p4_found": f"with {_VALUES} select table_name, class_id from (select *, sum(n) over (partition by table_name) total from (select table_name, class_id, count(*) n from vals group by all)) where n * 20 >= total",
    "p4_class_quantiles": f"""with {_VALUES},
      fin as (select table_name, class_id, w, row_number() over (partition by table_name, class_id order by w) rn, count(*) over (partition by table_name, class_id) n from vals where isfinite(w)),
      per as (select table_name, class_id, count(*) n_rows, count(*) filter (isfinite(w)) n_values from vals group by all),
      qs as (select *, greatest(1, cast(ceil(q * n_values) as bigint)) rank from per, (values (0.05::double), (0.25::double), (0.5::double), (0.75::double), (0.95::double)) s(q) where n_values > 0)
      select table_name, class_id, n_rows, n_values, q, rank, w + 0.0 as value from qs join fin using (table_name, class_id) where rn = rank
      union all select table_name, class_id, n_rows, n_values, null, null, null from per where n_values = 0""",
}
