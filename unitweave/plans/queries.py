"""Registered queries: the pipeline's operators over the driver's tables, each beside the SQL it must agree with.

The tables hold no departments, so both sides derive them alike: nations stand for institutions, orders for raw strings,
brands (with a word for their rank) for canonical names, and events in time order for a row's entities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitweave.functions import numeric as N
from unitweave.functions import text as T
from unitweave.functions import vocab
from unitweave.functions.kernels import token_sort_ratio
from unitweave.operators import canonical, entities, extract, hierarchy, release
from unitweave.plans.config import Config
from unitweave.plans.pipeline import Pipeline
from unitweave.sources import files, schemas
from unitweave.sources.stages import stage_path, stage_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# ---- extraction -----------------------------------------------------------------------------------------------------

WORK_SQL = """
wa AS (SELECT l_orderkey AS work_id, l_linenumber AS affiliation_seq, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_partkey END AS raw_affiliation_string_id FROM lineitem),
wai AS (SELECT l_orderkey AS work_id, l_linenumber AS affiliation_seq, l_suppkey AS institution_id FROM lineitem WHERE l_returnflag <> 'R'),
ras AS (SELECT p_partkey AS raw_affiliation_string_id, p_name AS raw_affiliation_string FROM part)
"""


def work_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    key = [F.col("l_orderkey").alias("work_id"), F.col("l_linenumber").alias("affiliation_seq")]
    raw = F.when(F.col("l_partkey") % 50 != 0, F.col("l_partkey")).alias("raw_affiliation_string_id")
    strings = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("raw_affiliation_string_id"), F.col("p_name").alias("raw_affiliation_string"))
    return lines.select(*key, raw), lines.where("l_returnflag != 'R'").select(*key, F.col("l_suppkey").alias("institution_id")), strings


@query(f"WITH {WORK_SQL}, c AS (SELECT raw_affiliation_string_id, count(DISTINCT institution_id) AS institution_count, count(DISTINCT work_id) AS frequency FROM wai JOIN wa USING (work_id, affiliation_seq) GROUP BY 1) SELECT raw_affiliation_string_id, institution_count, frequency, raw_affiliation_string FROM c JOIN ras USING (raw_affiliation_string_id)")
def raw_string_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.raw_string_counts(*work_tables(spark, sf_dir))


@query("SELECT n_regionkey, count(*) AS n, string_agg(n_nationkey::VARCHAR, ';' ORDER BY n_nationkey) AS in_order FROM nation GROUP BY 1")
def sorted_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export in order of its ids, numbered as read back from its files."""
    rows = extract.by_id(table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"))
    back = exported(spark, rows.coalesce(1), "n_nationkey int, n_regionkey int", one_file=True).withColumn("place", F.monotonically_increasing_id())
    listed = F.array_sort(F.collect_list(F.struct("place", "n_nationkey")))
    return back.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(listed, lambda x: x["n_nationkey"].cast("string")), ";").alias("in_order"))


# ---- sources and sinks ----------------------------------------------------------------------------------------------


def exported(spark: SparkSession, rows: DataFrame, schema: str, columns: list[str] | None = None, **how) -> DataFrame:
    """rows, written as CSV and read back."""
    path = stage_path(spark, "csv")
    files.write_csv(rows, path, **how)
    return files.read_csv(spark, path, schema, columns)


@query("SELECT doc_id, text, lang, nullif(source, '') AS source FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with quotes, commas and line ends through a CSV sink and scan."""
    return exported(spark, table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), "doc_id bigint, text string, lang string, source string")


@query("SELECT c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS c_acctbal FROM customer")
def csv_pruned_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed columns of a file with all cells quoted and nulls as empty cells; only two of them are read."""
    rows = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment").withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")))
    return exported(spark, rows, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string", ["c_name", "c_acctbal"], quote_all=True)


@query("SELECT event_id AS raw_affiliation_string_id, user_id AS institution_count, CASE WHEN event_id % 4 = 0 THEN 1 ELSE user_id END AS frequency, event_type AS word FROM events WHERE event_id % 5 <> 0")
def jsonl_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity rows through JSON lines: those without entities are not written, a missing frequency is 1."""
    some = F.array(F.struct(F.lit("SUB").alias("entity_group"), F.col("event_type").alias("word"), F.lit(0).alias("start"), F.length("event_type").alias("end")))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("raw_affiliation_string_id"), F.col("user_id").alias("institution_count"), F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("frequency"), F.when(F.col("event_id") % 5 != 0, some).otherwise(F.slice(some, 1, 0)).alias("entities"))
    path = stage_path(spark, "jsonl")
    files.write_entities(rows, path)
    return files.read_entities(spark, path, schemas.ENTITY_ROW)[0].select("raw_affiliation_string_id", "institution_count", "frequency", F.explode("entities.word").alias("word"))


@query("SELECT count(*) FILTER (user_id % 7 = 0) AS broken_lines, count(*) AS lines, count(*) FILTER (user_id % 7 <> 0) AS with_id FROM events")
def jsonl_broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no JSON are counted and skipped."""
    line = F.when(F.col("user_id") % 7 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"raw_affiliation_string_id": '), F.col("event_id").cast("string"), F.lit(', "entities": []}')))
    path = stage_path(spark, "lines")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return files.read_entities(spark, path, schemas.ENTITY_ROW)[1]


@query("WITH t AS (SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 150) SELECT doc_id FROM t WHERE lang = 'en'")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row limit of a smoke run, which comes before the language filter."""
    rows = table(spark, sf_dir, "documents", "doc_id", F.col("lang").alias("language"))
    return entities.keep_language(entities.first_rows(rows, 150, "doc_id"), "en").select("doc_id")


@query("SELECT v.vec_id, list_position(e, list_max(e)) - 1 AS index, round(1.0e0 / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 9) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) v")
def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stand for a token's logits."""
    best = N.softmax_best(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", best["index"].alias("index"), F.round(best["score"], 9).alias("score"))


@query(f"WITH {WORK_SQL}, p AS (SELECT DISTINCT raw_affiliation_string_id, institution_id FROM wa JOIN wai USING (work_id, affiliation_seq) WHERE raw_affiliation_string_id IS NOT NULL) SELECT raw_affiliation_string_id, count(institution_id) AS institution_count, string_agg(institution_id::VARCHAR, ';' ORDER BY institution_id) AS institution_ids_str FROM p GROUP BY 1")
def ordered_distinct_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    affiliations, links, _ = work_tables(spark, sf_dir)
    return extract.institution_lists(affiliations, links)


@query("SELECT n_nationkey AS institution_id, n_name AS institution_name FROM nation")
def dim_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.institution_names(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("institution_id"), F.col("n_name").alias("institution_name")))


@query("SELECT n_nationkey AS institution_id FROM nation WHERE n_regionkey = 3")
def type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.education_institutions(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("institution_id"), F.col("n_regionkey").alias("institution_type_id")))


@query(f"WITH {WORK_SQL}, p AS (SELECT DISTINCT raw_affiliation_string_id, institution_id FROM wa JOIN wai USING (work_id, affiliation_seq) WHERE raw_affiliation_string_id IS NOT NULL) SELECT raw_affiliation_string_id, institution_id FROM p")
def id_list_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_distinct_list(spark, sf_dir).select("raw_affiliation_string_id", F.explode(T.split_ids(F.col("institution_ids_str"))).alias("institution_id"))


# ---- language and text ----------------------------------------------------------------------------------------------

_LANG = ", ".join(f"len(list_filter(w, lambda x: list_contains({_sql_list(words)}, x))) AS n{i}" for i, words in enumerate(vocab.FUNCTION_WORDS.values()))
_LANG_CASE = " ".join(f"WHEN n{i} = greatest(n0, n1, n2, n3) THEN '{name}'" for i, name in enumerate(vocab.FUNCTION_WORDS))
LANG_SQL = rf"""
t AS (SELECT doc_id, text, regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}]+') AS w FROM documents), n AS (SELECT doc_id, text, {_LANG} FROM t),
tagged AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '[\x{{3040}}-\x{{30ff}}]') THEN 'JAPANESE' WHEN regexp_matches(text, '[\x{{4e00}}-\x{{9fff}}]') THEN 'CHINESE'
  WHEN regexp_matches(text, '[\x{{0400}}-\x{{04ff}}]') THEN 'RUSSIAN' WHEN n0 + n1 + n2 + n3 = 0 THEN 'UNKNOWN' {_LANG_CASE} END AS language FROM n)
"""


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").withColumn("language", T.language(F.col("text")))


@query(f"WITH {LANG_SQL} SELECT doc_id, language FROM tagged")
def lang_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select("doc_id", "language")


@query(f"WITH {LANG_SQL} SELECT doc_id FROM tagged WHERE language = 'ENGLISH'")
def lang_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.keep_language(tagged(spark, sf_dir)).select("doc_id")


@query(r"""
WITH a AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents), b AS (SELECT doc_id, regexp_replace(t, ' +([,;:.)\]}])', '\1', 'g') AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, '([,;:.({\[]) +', '\1', 'g') AS t FROM b), d AS (SELECT doc_id, regexp_replace(t, '([,;:.)\]}])([a-zA-Z0-9])', '\1 \2', 'g') AS t FROM c),
e AS (SELECT doc_id, trim(regexp_replace(t, '([a-zA-Z0-9])([({\[])', '\1 \2', 'g')) AS t FROM d)
SELECT doc_id, regexp_replace(regexp_replace(t, '^[(\[{]+', ''), '[)\]}]+$', '') AS clean FROM e
""")
def clean_affiliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_affiliation(F.col("text")).alias("clean"))


_STOP = "|".join(vocab.STOP_WORDS)
DEPT_SQL = rf"""
a AS (SELECT id, regexp_replace(lower(raw), '\(.*$', ' ') AS t FROM raw_names), b AS (SELECT id, replace(regexp_replace(t, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), 'amp', ' ') AS t FROM a),
c AS (SELECT id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM b), d AS (SELECT id, regexp_replace(regexp_replace(t, '^(?:(?:{_STOP})(?: |$))+', ''), '(?:(?:^| )(?:{_STOP}))+$', '') AS t FROM c),
cleaned AS (SELECT id, CASE WHEN regexp_matches(t, '{"|".join(vocab.TYPE_WORDS)}') THEN trim(regexp_replace(t, '^\d+\s*', '')) ELSE '' END AS clean FROM d)
"""
RAW_NAMES_SQL = "raw_names AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'The Department of ' || p_name || ' (' || p_brand || ')' WHEN 1 THEN p_partkey || ' School, of ' || p_name WHEN 2 THEN p_name || ' Campus Lab' WHEN 3 THEN 'Dept. ' || p_name || ' & ' || p_type WHEN 4 THEN p_name || ' ' || p_type ELSE 'Jane Doe Univ of ' || p_name || ' and the' END AS raw FROM part)"


def raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 6
    join = lambda *x: F.concat(*[F.col(y[1:]) if y.startswith("$") else F.lit(y) for y in x])
    raw = (
        F.when(k == 0, join("The Department of ", "$p_name", " (", "$p_brand", ")")).when(k == 1, F.concat(F.col("p_partkey").cast("string"), join(" School, of ", "$p_name")))
        .when(k == 2, join("$p_name", " Campus Lab")).when(k == 3, join("Dept. ", "$p_name", " & ", "$p_type")).when(k == 4, join("$p_name", " ", "$p_type")).otherwise(join("Jane Doe Univ of ", "$p_name", " and the"))
    )
    return p.select(F.col("p_partkey").alias("id"), raw.alias("raw"))


@query(f"WITH {RAW_NAMES_SQL}, {DEPT_SQL} SELECT id, clean FROM cleaned")
def clean_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_names(spark, sf_dir).select("id", T.clean_department(F.col("raw")).alias("clean"))


@query(f"WITH raw_names AS (SELECT doc_id AS id, text AS raw FROM documents), {DEPT_SQL} SELECT id, clean FROM cleaned")
def clean_department_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.clean_department(F.col("text")).alias("clean"))


@query(rf"WITH {RAW_NAMES_SQL}, {DEPT_SQL} SELECT id, regexp_matches(clean, '\b(?:{'|'.join(vocab.ABBREVIATIONS)})\b') AS abbreviated FROM cleaned")
def is_abbreviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_department(spark, sf_dir).select("id", T.is_abbreviation(F.col("clean")).alias("abbreviated"))


FOLD_SQL = r"folded AS (SELECT id, trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(lower(strip_accents(raw)), '[^\x00-\x7f]', '', 'g'), '&', ' and '), '.', ' '), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS folded FROM raw_names)"
@query(f"WITH raw_names AS (SELECT doc_id AS id, text AS raw FROM documents), {FOLD_SQL} SELECT id, folded FROM folded")
def fold_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.fold_name(F.col("text")).alias("folded"))


_TYPE = rf"^(.*?)\b(?:{'|'.join(vocab.TYPE_WORDS)})\b(.*)$"
CORE_SQL = rf"""
k AS (SELECT id, folded, CASE WHEN regexp_matches(folded, '{_TYPE}') THEN coalesce(nullif(trim(regexp_extract(folded, '{_TYPE}', 2)), ''), nullif(trim(regexp_extract(folded, '{_TYPE}', 1)), ''), '') ELSE folded END AS c FROM folded),
s AS (SELECT id, folded, trim(regexp_replace(regexp_replace(c, '\b(?:{_STOP})\b', '', 'g'), '\s+', ' ', 'g')) AS c FROM k)
SELECT id, coalesce(nullif(c, ''), folded) AS core FROM s
"""


@query(f"WITH {RAW_NAMES_SQL}, {FOLD_SQL}, {CORE_SQL}")
def core_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_names(spark, sf_dir).select("id", T.core_name(T.fold_name(F.col("raw"))).alias("core"))


def split_sql(source: str, name: str, most: int, keep: str) -> str:
    """CTEs that split the names of a source; the last is called parted."""
    return rf"""
    tok AS (SELECT *, list_filter(regexp_split_to_array({name}, '\s+'), lambda x: x <> '') AS w FROM {source}),
    pos AS (SELECT *, list_filter(range(1, len(w)), lambda i: list_contains({_sql_list(vocab.CUE_WORDS)}, w[i]))[1] AS p FROM tok),
    parted AS (SELECT {keep}, CASE WHEN p IS NULL THEN '' ELSE array_to_string(w[1:p - 1], ' ') END AS prefix, CASE WHEN p IS NULL THEN '' ELSE array_to_string(w[p:], ' ') END AS suffix,
      coalesce(p > 1 AND p - 1 <= {most} AND len(list_filter(w[1:p - 1], lambda x: NOT regexp_full_match(regexp_replace(x, '[-''.]', '', 'g'), '\p{{L}}+') OR list_contains({_sql_list(vocab.NOT_IN_PREFIX)}, regexp_replace(x, '[-''.]', '', 'g')))) = 0, false) AS valid FROM pos)
    """


NAMES_SQL = """names AS (SELECT (l_suppkey % 25)::BIGINT AS institution_id, CASE p_size % 4 WHEN 0 THEN p_name || ' school of ' || lower(p_type) WHEN 1 THEN 'school of ' || lower(p_type) WHEN 2 THEN 'department of ' || p_name ELSE p_name || ' department' END AS name,
  sum(l_quantity)::BIGINT AS frequency FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    name = (
        F.when(k == 0, F.concat("p_name", F.lit(" school of "), F.lower("p_type"))).when(k == 1, F.concat(F.lit("school of "), F.lower("p_type")))
        .when(k == 2, F.concat(F.lit("department of "), F.col("p_name"))).otherwise(F.concat("p_name", F.lit(" department")))
    )
    rows = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_quantity").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.groupBy((F.col("l_suppkey") % 25).alias("institution_id"), name.alias("clean_dept_str")).agg(F.sum("l_quantity").cast("long").alias("frequency"))
    return canonical.load_names(rows)


@query(f"WITH {NAMES_SQL}, {split_sql('names', 'name', 3, '*')} SELECT DISTINCT name, prefix, suffix, valid FROM parted")
def prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("name").distinct().withColumn("s", T.split_prefix(F.col("name"))).select("name", "s.prefix", "s.suffix", "s.valid")


# ---- canonical names ------------------------------------------------------------------------------------------------

LOOSE = Config(max_full_frequency=10**9, max_prefixed_ratio=0.2, min_suffix_variant_frequency=50, min_core_group_frequency=50)


@query(f"WITH {NAMES_SQL} SELECT institution_id, name, frequency FROM names WHERE trim(name) <> '' AND frequency >= 1")
def load_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names(spark, sf_dir).select("institution_id", "name", "frequency")


@query(f"WITH {NAMES_SQL}, few AS (SELECT institution_id FROM (SELECT DISTINCT institution_id FROM names WHERE institution_id IN (1, 2, 3, 11)) ORDER BY institution_id::VARCHAR LIMIT 3) SELECT institution_id, name, frequency FROM names JOIN few USING (institution_id) WHERE frequency >= 40")
def chosen_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice of institutions, its limit and the least frequency."""
    config = Config(institution_ids=(1, 2, 3, 11), limit_institutions=3, min_frequency=40)
    return canonical.check_names(canonical.load_names(names(spark, sf_dir), config), config).select("institution_id", "name", "frequency")


@query(f"WITH {NAMES_SQL} SELECT institution_id, left(name, 9) AS name, sum(frequency)::BIGINT AS frequency FROM names GROUP BY 1, 2")
def normalised_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by a name that several raw names share."""
    return canonical.records(names(spark, sf_dir).withColumn("name", F.substring("name", 1, 9)))


@query(f"""WITH {NAMES_SQL}, {split_sql('names', 'name', 3, '*')}, f AS (SELECT *, CASE WHEN suffix <> '' THEN sum(frequency) OVER (PARTITION BY institution_id, suffix) ELSE 0 END AS s, sum(frequency) OVER (PARTITION BY institution_id, name) AS t FROM parted)
SELECT institution_id, name AS clean_dept_str, CASE WHEN valid AND suffix <> '' AND s >= 3 AND t::DOUBLE / s <= 0.2 THEN suffix ELSE name END AS name, frequency FROM f""")
def person_prefix_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.strip_person_prefixes(names(spark, sf_dir), LOOSE)


@query(f"""WITH {NAMES_SQL}, {split_sql('names', 'name', 4, '*')}, g AS (SELECT institution_id, suffix, sum(frequency) FILTER (valid) AS total, count(DISTINCT prefix) FILTER (valid) AS variants, first(name ORDER BY frequency DESC, length(name) DESC, name) AS best FROM parted WHERE suffix <> '' GROUP BY 1, 2)
SELECT parted.institution_id, name AS clean_dept_str, CASE WHEN total >= 50 AND variants >= 2 THEN best ELSE name END AS name, frequency FROM parted LEFT JOIN g ON parted.institution_id = g.institution_id AND parted.suffix = g.suffix""")
def suffix_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.unify_suffix_variants(names(spark, sf_dir), LOOSE)


@query(f"""WITH {NAMES_SQL}, raw_names AS (SELECT DISTINCT name AS id, name AS raw FROM names), {FOLD_SQL}, cores AS (WITH {CORE_SQL}),
g AS (SELECT institution_id, core, sum(frequency) AS total, count(DISTINCT name) AS variants, first(name ORDER BY frequency DESC, length(name) DESC, name) AS best FROM names JOIN cores ON id = name WHERE core <> '' GROUP BY 1, 2)
SELECT names.institution_id, name AS clean_dept_str, CASE WHEN total >= 50 AND variants >= 2 THEN best ELSE name END AS name, frequency FROM names JOIN cores ON id = name LEFT JOIN g ON names.institution_id = g.institution_id AND cores.core = g.core""")
def core_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.unify_core_variants(names(spark, sf_dir), LOOSE)


CLUSTERED_SQL = f"{NAMES_SQL}, clustered AS (SELECT institution_id, regexp_extract(name, '(\\S+)$', 1) AS cluster, name, frequency FROM names)"


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names under their last word, which stands for the label of a cluster."""
    return names(spark, sf_dir).select("institution_id", F.regexp_extract("name", r"(\S+)$", 1).alias("cluster"), "name", "clean_dept_str", "frequency")


@query(f"WITH {CLUSTERED_SQL} SELECT institution_id, cluster, first(name ORDER BY frequency DESC, length(name), lower(name), name) AS canonical_dept_name, sum(frequency)::BIGINT AS cluster_total_frequency, count(*) AS member_count FROM clustered GROUP BY 1, 2")
def cluster_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_names(clustered(spark, sf_dir))


@query(f"WITH {CLUSTERED_SQL} SELECT institution_id, cluster AS name, string_agg(name || ':' || frequency, ';' ORDER BY frequency DESC, name) AS members FROM clustered GROUP BY 1, 2")
def member_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clustered(spark, sf_dir).withColumn("name", F.col("cluster"))
    told = F.array_join(F.transform("members", lambda m: F.concat(m["raw_name"], F.lit(":"), m["frequency"].cast("string"))), ";")
    return canonical.members(rows).select("institution_id", "name", told.alias("members"))


@query(f"WITH {CLUSTERED_SQL}, c AS (SELECT institution_id, cluster, first(name ORDER BY frequency DESC, length(name), lower(name), name) AS best, sum(frequency)::BIGINT AS total FROM clustered GROUP BY 1, 2) SELECT institution_id, best AS canonical_dept_name, total AS cluster_total_frequency, name AS member_dept_name FROM clustered JOIN c USING (institution_id, cluster)")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clustered(spark, sf_dir)
    return canonical.cluster_rows(rows, canonical.members(rows))


@query(f"""WITH {CLUSTERED_SQL} SELECT institution_id, first(name ORDER BY frequency DESC, length(name), lower(name), name) AS canonical_dept_name, sum(frequency)::BIGINT AS total_frequency, count(*) AS member_count,
  '[' || string_agg('{{"raw_name":"' || name || '","frequency":' || frequency || ',"normalized_name":"' || name || '"}}', ',' ORDER BY frequency DESC, lower(name)) || ']' AS member_details FROM clustered GROUP BY institution_id, cluster""")
def cluster_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clustered(spark, sf_dir)
    return canonical.cluster_rows(rows, canonical.members(rows), detailed=True)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label stand for the names of one institution."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("institution_id"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("name"), "embedding")


VECTORS_SQL = "v AS (SELECT label::BIGINT AS institution_id, lpad(vec_id::VARCHAR, 12, '0') AS name, embedding::DOUBLE[] AS e, vec_id % 7 AS c FROM embeddings), p AS (SELECT a.institution_id, a.name AS dept_a, b.name AS dept_b, a.c AS ca, b.c AS cb, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.institution_id = b.institution_id AND a.name < b.name)"


@query(f"WITH {VECTORS_SQL} SELECT institution_id, dept_a, dept_b, round(s, 6) AS similarity, round(1 - s, 6) AS distance FROM p")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.cosine_pairs(vectors(spark, sf_dir))


@query(f"WITH {VECTORS_SQL} SELECT institution_id, dept_a, dept_b, round(s, 4) AS similarity FROM p WHERE ca <> cb AND s >= 1.0 - 0.75 - 0.05 AND s < 1.0 - 0.75")
def borderline_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return canonical.borderline_pairs(rows, rows.select("institution_id", "name", (F.col("name").cast("long") % 7).cast("string").alias("cluster")), 0.75, 0.05)


#: The nearest two clusters of an institution become one, a step at a time, while their mean distance lies below the threshold.
LINKED_SQL = """WITH RECURSIVE v AS (SELECT label::BIGINT AS institution_id, lpad(vec_id::VARCHAR, 12, '0') AS name, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.institution_id, a.name AS a, b.name AS b, 1 - list_cosine_similarity(a.e, b.e) AS d FROM v a JOIN v b ON a.institution_id = b.institution_id AND a.name <> b.name),
state AS (SELECT institution_id, 0 AS step, name, name AS cluster FROM v
  UNION ALL SELECT s.institution_id, s.step + 1, s.name, CASE WHEN s.cluster = m.y THEN m.x ELSE s.cluster END FROM state s JOIN (
    SELECT institution_id, arg_min(x, far) AS x, arg_min(y, far) AS y FROM (SELECT p.institution_id, p.cluster AS x, q.cluster AS y, avg(d.d) AS far FROM state p JOIN state q ON p.institution_id = q.institution_id AND p.cluster < q.cluster JOIN d ON d.institution_id = p.institution_id AND d.a = p.name AND d.b = q.name GROUP BY 1, 2, 3)
    GROUP BY 1 HAVING min(far) < 0.75) m ON s.institution_id = m.institution_id)
SELECT institution_id, name, cluster FROM state QUALIFY step = max(step) OVER (PARTITION BY institution_id)"""


@query(LINKED_SQL)
def agglomerative_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.cluster_records(vectors(spark, sf_dir), 0.75, "average")


def ratio_sql(pairs: str) -> str:
    """CTEs that add score to pairs (a, b, ...): the token sort ratio, by rows of the table of common subsequences; the last is called rated."""
    return f"""
    sorted_pairs AS (SELECT *, array_to_string(list_sort(regexp_extract_all(a, '[^ ]+')), ' ') AS x, array_to_string(list_sort(regexp_extract_all(b, '[^ ]+')), ' ') AS y FROM {pairs}),
    hits AS (SELECT *, list_concat([list_transform(range(length(y)), lambda i: 0)], list_transform(regexp_extract_all(x, '.'), lambda c: list_transform(regexp_extract_all(y, '.'), lambda d: (c = d)::INT))) AS h FROM sorted_pairs),
    rated AS (SELECT * EXCLUDE (h), 200.0e0 * coalesce(list_reduce(h, lambda before, hit: list_transform(range(1, len(hit) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(before[k], coalesce(before[k - 1], 0) + hit[k])))))[-1], 0) / (length(x) + length(y)) AS score FROM hits)
    """


@query(f"""WITH p AS (SELECT DISTINCT p_brand, p_name FROM part), pairs AS (SELECT DISTINCT m.p_name AS a, n.p_name AS b FROM p m JOIN p n ON m.p_brand = n.p_brand AND m.p_name <> n.p_name), {ratio_sql('pairs')},
f AS (SELECT m.p_brand, m.p_name, n.p_name AS other, r.score, row_number() OVER (PARTITION BY m.p_brand, m.p_name ORDER BY r.score DESC, n.p_name DESC) AS k FROM p m JOIN p n ON m.p_brand = n.p_brand JOIN rated r ON r.a = m.p_name AND r.b = n.p_name)
SELECT p_brand, p_name, other, score FROM f WHERE k = 1 AND score >= 75""")
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part name against the distinct part names of its brand, best match other than itself."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_name").distinct()
    offered = parts.join(parts.withColumnRenamed("p_name", "other"), "p_brand").where("p_name != other")
    scored = offered.select("p_name", "other").distinct().withColumn("score", token_sort_ratio("p_name", "other"))
    return offered.join(scored, ["p_name", "other"]).groupBy("p_brand", "p_name").agg(F.max(F.struct("score", "other")).alias("m")).where("m.score >= 75").select("p_brand", "p_name", "m.other", "m.score")


# ---- hierarchy ------------------------------------------------------------------------------------------------------

BASE_SQL = """base AS (SELECT c_nationkey::BIGINT AS institution_id, l_orderkey AS raw_affiliation_id,
  (['faculty of ', 'school of ', 'department of ', 'centre for ', ''])[substr(p_brand, 7)::INT % 5 + 1] || lower(p_brand) AS canonical_dept_name, min(l_linenumber) AS start, sum(l_quantity)::BIGINT AS frequency
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
inst AS (SELECT n_nationkey::BIGINT AS institution_id, CASE WHEN n_nationkey % 5 = 0 THEN 'School of Brand#1' ELSE n_name END AS institution_name, n_regionkey FROM nation)"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    rows = lines.join(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    ranks = F.array(*[F.lit(x) for x in ("faculty of ", "school of ", "department of ", "centre for ", "")])
    name = F.concat(F.get(ranks, F.substring("p_brand", 7, 9).cast("int") % 5), F.lower("p_brand"))
    keys = [F.col("c_nationkey").cast("long").alias("institution_id"), F.col("l_orderkey").alias("raw_affiliation_id"), name.alias("canonical_dept_name")]
    return rows.groupBy(*keys).agg(F.min("l_linenumber").alias("start"), F.sum("l_quantity").cast("long").alias("frequency"))


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("n_nationkey") % 5 == 0, F.lit("School of Brand#1")).otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("institution_id"), name.alias("institution_name"), F.col("n_regionkey").alias("institution_type_id"))


COVER_SQL = """sums AS (SELECT institution_id, canonical_dept_name, sum(frequency)::BIGINT AS f FROM base GROUP BY 1, 2),
cover AS (SELECT institution_id, canonical_dept_name FROM (SELECT *, coalesce(sum(f) OVER (PARTITION BY institution_id ORDER BY f DESC, canonical_dept_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(f) OVER (PARTITION BY institution_id) AS total FROM sums) WHERE total > 0 AND before < total * 0.95::DOUBLE),
kept AS (SELECT base.* FROM base JOIN cover USING (institution_id, canonical_dept_name))"""


def covered(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    rows = rows or stage_table(base(spark, sf_dir), "base")
    return stage_table(rows.join(hierarchy.top_coverage(rows), ["institution_id", "canonical_dept_name"], "left_semi"), "covered")


@query(f"WITH {BASE_SQL}, {COVER_SQL} SELECT institution_id, canonical_dept_name FROM cover")
def top_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.top_coverage(base(spark, sf_dir))


GRAPH_SQL = """rec AS (SELECT institution_id, raw_affiliation_id AS raw, canonical_dept_name AS name, row_number() OVER (PARTITION BY institution_id, raw_affiliation_id ORDER BY start, canonical_dept_name) AS i, count(*) OVER (PARTITION BY institution_id, raw_affiliation_id) AS m FROM kept
  UNION ALL SELECT DISTINCT institution_id, raw_affiliation_id, '__INST__' || institution_id, 0, count(*) OVER (PARTITION BY institution_id, raw_affiliation_id) FROM kept),
node AS (SELECT institution_id, name, count(*) AS frequency, avg(i::DOUBLE / m) AS position FROM rec GROUP BY 1, 2),
pair AS (SELECT x.institution_id, least(x.name, y.name) AS a, greatest(x.name, y.name) AS b, count(*) AS n, count(*) FILTER (x.name < y.name) AS a_first FROM rec x JOIN rec y ON x.institution_id = y.institution_id AND x.raw = y.raw AND x.i < y.i GROUP BY 1, 2, 3),
deg AS (SELECT institution_id, name, count(*) AS degree FROM (SELECT institution_id, a AS name FROM pair UNION ALL SELECT institution_id, b FROM pair) GROUP BY 1, 2)"""
_RANK = "CASE WHEN starts_with(name, '__INST__') THEN 0 " + " ".join(f"WHEN list_has_any(regexp_extract_all(lower(name), '[a-z]+'), {_sql_list(words)}) THEN {rank}" for rank, words in vocab.RANK_WORDS.items()) + " END"
SCORE_SQL = f"""info AS (SELECT node.*, degree, {_RANK} AS rank, 1.0e0 / (1.0e0 + ln(1.0e0 + frequency)) AS scale FROM node JOIN deg USING (institution_id, name)),
j AS (SELECT p.institution_id, p.a, p.b, p.n::DOUBLE AS n, p.a_first::DOUBLE AS af, (p.n - p.a_first)::DOUBLE AS bf, x.frequency::DOUBLE AS fa, y.frequency::DOUBLE AS fb, x.degree::DOUBLE AS da, y.degree::DOUBLE AS db, x.position AS pa, y.position AS pb, x.rank AS ra, y.rank AS rb, x.scale AS sa, y.scale AS sb
  FROM pair p JOIN info x ON p.institution_id = x.institution_id AND p.a = x.name JOIN info y ON p.institution_id = y.institution_id AND p.b = y.name WHERE p.n >= 2 AND p.n::DOUBLE / least(x.frequency, y.frequency) >= 0.01e0),
q AS (SELECT *, 0.4e0 * (n / fb - n / fa) + 0.1e0 * ((da - db) / (da + db)) + 0.2e0 * ((fa - fb) / (fa + fb)) AS base_score, CASE WHEN ra > 0 THEN ra ELSE 5 END AS ka, CASE WHEN rb > 0 THEN rb ELSE 5 END AS kb FROM j),
edge AS (SELECT institution_id, a AS parent_dept, b AS child_dept, round((base_score + 0.3e0 * (0.5e0 * greatest(-1.0e0, least(1.0e0, pa - pb)) + 0.5e0 * ((bf - af) / n)) + CASE WHEN ra > 0 AND rb > 0 THEN greatest(-0.25e0, least(0.25e0, (rb - ra) / 4.0e0)) ELSE 0.0e0 END - 0.15e0 * greatest(kb - ka - 1, 0)) * sa, 12) AS direction_score FROM q
  UNION ALL SELECT institution_id, b, a, round((-base_score + 0.3e0 * (0.5e0 * greatest(-1.0e0, least(1.0e0, pb - pa)) + 0.5e0 * ((af - bf) / n)) + CASE WHEN ra > 0 AND rb > 0 THEN greatest(-0.25e0, least(0.25e0, (ra - rb) / 4.0e0)) ELSE 0.0e0 END - 0.15e0 * greatest(ka - kb - 1, 0)) * sb, 12) FROM q),
strong AS (SELECT edge.* FROM edge JOIN (SELECT institution_id, greatest(0.0e0, quantile_cont(direction_score, 0.5)) AS t FROM edge GROUP BY 1) USING (institution_id) WHERE direction_score >= t AND NOT starts_with(child_dept, '__INST__')),
topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY institution_id, child_dept ORDER BY direction_score DESC, parent_dept) AS k FROM strong) WHERE k <= 3)"""
GRAPH = f"WITH {BASE_SQL}, {COVER_SQL}, {GRAPH_SQL}"
SCORES = f"{GRAPH}, {SCORE_SQL}"


def graph_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.record_positions(covered(spark, sf_dir))


@query(f"{GRAPH} SELECT institution_id, a, b, n, a_first, n - a_first AS b_first FROM pair")
def cooccur_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.pairs(graph_records(spark, sf_dir))


@query(f"{GRAPH} SELECT institution_id, name, frequency, round(position, 9) AS position FROM node")
def node_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.nodes(graph_records(spark, sf_dir)).withColumn("position", F.round("position", 9))


@query(f"{GRAPH} SELECT institution_id, name, degree FROM deg")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.degrees(hierarchy.pairs(graph_records(spark, sf_dir)))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_table(hierarchy.score_edges(graph_records(spark, sf_dir)), "edges")


@query(f"{SCORES} SELECT institution_id, parent_dept, child_dept, round(direction_score, 6) + 0.0e0 AS direction_score FROM edge")
def edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).withColumn("direction_score", F.round("direction_score", 6) + F.lit(0.0))


@query(f"{SCORES} SELECT institution_id, parent_dept, child_dept, round(direction_score, 6) + 0.0e0 AS direction_score FROM strong")
def edge_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.keep_strong(edges(spark, sf_dir)).withColumn("direction_score", F.round("direction_score", 6) + F.lit(0.0))


@query(f"{SCORES} SELECT institution_id, parent_dept, child_dept, k FROM topk")
def topk_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = hierarchy.top_parents(hierarchy.keep_strong(edges(spark, sf_dir)))
    w = Window.partitionBy("institution_id", "child_dept").orderBy(F.col("direction_score").desc(), "parent_dept")
    return best.select("institution_id", "parent_dept", "child_dept", F.row_number().over(w).cast("long").alias("k"))


#: Edges in order of preference, one a step for each institution; above holds every pair of a unit and one below it.
FOREST_SQL = f"""{SCORES.replace('WITH', 'WITH RECURSIVE', 1)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY direction_score DESC, parent_dept, child_dept) AS place FROM topk),
walk AS (SELECT institution_id, 0::BIGINT AS place, false AS taken, []::STRUCT(up VARCHAR, down VARCHAR)[] AS above FROM (SELECT DISTINCT institution_id FROM ranked)
  UNION ALL SELECT institution_id, place, taken, CASE WHEN taken THEN list_concat(above, flatten(list_transform(list_append(list_transform(list_filter(above, lambda x: x.down = parent_dept), lambda x: x.up), parent_dept),
    lambda u: list_transform(list_append(list_transform(list_filter(above, lambda x: x.up = child_dept), lambda x: x.down), child_dept), lambda d: {{'up': u, 'down': d}})))) ELSE above END
  FROM (SELECT r.*, above, parent_dept <> child_dept AND len(list_filter(above, lambda x: x.down = child_dept)) = 0 AND NOT list_contains(above, {{'up': child_dept, 'down': parent_dept}}) AS taken
    FROM walk w JOIN ranked r ON r.institution_id = w.institution_id AND r.place = w.place + 1)),
forest AS (SELECT r.institution_id, parent_dept, child_dept, direction_score FROM ranked r JOIN walk w ON r.institution_id = w.institution_id AND r.place = w.place WHERE taken)"""


@query(f"{FOREST_SQL} SELECT institution_id, parent_dept, child_dept, round(direction_score, 6) + 0.0e0 AS direction_score FROM forest")
def parent_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest(spark, sf_dir, covered(spark, sf_dir)).withColumn("direction_score", F.round("direction_score", 6) + F.lit(0.0))


TREE_SQL = f"""{FOREST_SQL},
tree AS (SELECT forest.institution_id, lower(institution_name) AS institution_name, lower(CASE WHEN starts_with(parent_dept, '__INST__') THEN coalesce(institution_name, parent_dept) ELSE parent_dept END) AS parent_name, lower(child_dept) AS child_name FROM forest LEFT JOIN inst USING (institution_id)
  UNION SELECT u.institution_id, lower(institution_name), lower(institution_name), lower(canonical_dept_name) FROM (SELECT DISTINCT institution_id, canonical_dept_name FROM kept) u LEFT JOIN inst USING (institution_id) WHERE NOT EXISTS (SELECT 1 FROM forest WHERE forest.institution_id = u.institution_id AND forest.child_dept = u.canonical_dept_name))"""


def forest(spark: SparkSession, sf_dir: str, kept: DataFrame) -> DataFrame:
    scored = stage_table(hierarchy.score_edges(hierarchy.record_positions(kept)), "edges")
    return hierarchy.parent_forest(hierarchy.top_parents(hierarchy.keep_strong(scored)))


def tree(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Each unit under its parent in the forest, or under its institution. rows: base(), where it is at hand."""
    kept = covered(spark, sf_dir, rows)
    return stage_table(hierarchy.complete_roots(stage_table(forest(spark, sf_dir, kept), "forest"), kept, institutions(spark, sf_dir)), "tree")


@query(f"{TREE_SQL} SELECT institution_id, institution_name, parent_name, child_name FROM tree")
def root_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(spark, sf_dir)


@query(f"{TREE_SQL} SELECT institution_id, institution_name, parent_name, child_name FROM tree")
def hierarchy_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.build(base(spark, sf_dir), institutions(spark, sf_dir))


@query(f"WITH n AS (SELECT DISTINCT (['faculty of ', 'school of ', 'department of ', 'centre for ', ''])[substr(p_brand, 7)::INT % 5 + 1] || lower(p_brand) AS name FROM part UNION SELECT '__INST__1'), r AS (SELECT name, {_RANK} AS rank FROM n) SELECT a.name AS parent, b.name AS child, coalesce(a.rank, -1) AS parent_rank, coalesce(b.rank, -1) AS child_rank, CASE WHEN a.rank > 0 AND b.rank > 0 THEN greatest(-0.25e0, least(0.25e0, (b.rank - a.rank) / 4.0e0)) ELSE 0.0e0 END AS bonus, round(-0.15e0 * greatest((CASE WHEN b.rank > 0 THEN b.rank ELSE 5 END) - (CASE WHEN a.rank > 0 THEN a.rank ELSE 5 END) - 1, 0), 6) + 0.0e0 AS penalty FROM r a JOIN r b ON a.name <> b.name")
def lexical_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the distinct names, of which there are as many as brands: each name explodes the list of them."""
    ranks = F.array(*[F.lit(x) for x in ("faculty of ", "school of ", "department of ", "centre for ", "")])
    name = F.concat(F.get(ranks, F.substring("p_brand", 7, 9).cast("int") % 5), F.lower("p_brand")).alias("name")
    n = table(spark, sf_dir, "part").select(name).distinct().unionByName(spark.range(1).select(F.lit("__INST__1").alias("name")))
    r = n.select(F.col("name").alias("parent"), N.lexical_rank(F.col("name")).alias("parent_rank"))
    listed = F.collect_list(F.struct(F.col("parent").alias("child"), F.col("parent_rank").alias("child_rank"))).over(Window.partitionBy())
    both = r.withColumn("all", listed).select("parent", "parent_rank", F.inline("all")).where("parent != child")
    told = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("parent_rank", "child_rank")]
    return both.select("parent", "child", *told, N.lexical_bonus(F.col("parent_rank"), F.col("child_rank")).alias("bonus"), F.round(N.gap_penalty(F.col("parent_rank"), F.col("child_rank")), 6).alias("penalty"))


@query("SELECT o_orderkey, round(CASE WHEN o_custkey <= 0 THEN 1.0e0 ELSE 1.0e0 / (1.0e0 + ln(1.0e0 + o_custkey)) END, 9) AS scale FROM orders")
def frequency_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(N.frequency_scale(F.col("o_custkey")), 9).alias("scale"))


# ---- entities -------------------------------------------------------------------------------------------------------

EVENTS_SQL = "e AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS k FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w) - 1)


@query(f"WITH {EVENTS_SQL}, s AS (SELECT user_id, event_id, k, CASE WHEN event_type = 'error' THEN NULL ELSE floor(value)::INT END AS start FROM e), p AS (SELECT *, last_value(start IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s), g AS (SELECT *, sum(CASE WHEN start < before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k) AS segment FROM p) SELECT user_id, event_id, start, segment::BIGINT AS segment, (row_number() OVER (PARTITION BY user_id, segment ORDER BY k) - 1)::INT AS place FROM g")
def segment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", "k", F.when(F.col("event_type") != "error", F.floor("value").cast("int")).alias("start"))
    return entities.with_segments(rows, ["user_id"], ["k"]).drop("k")


@query(f"WITH {EVENTS_SQL}, s AS (SELECT user_id, k, event_type AS g, k * 5 AS a, k * 5 + CASE WHEN event_id % 3 = 0 THEN 4 ELSE 5 END AS b FROM e), f AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(g) OVER w = g THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY user_id ORDER BY k)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY k) AS island FROM f) SELECT user_id, g AS entity_group, min(a) AS start, max(b) AS \"end\", string_agg(g, '' ORDER BY k) AS word FROM i GROUP BY user_id, island, g")
def merge_touching_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.col("k") * 5 + F.when(F.col("event_id") % 3 == 0, 4).otherwise(5)
    entity = F.struct(F.col("event_type").alias("entity_group"), (F.col("k") * 5).alias("start"), end.alias("end"), F.col("event_type").alias("word"), F.col("value").alias("score"))
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("k", entity.alias("e")))).alias("l"))
    merged = entities.merge_touching(F.transform("l", lambda x: x["e"]))
    return rows.select("user_id", F.inline(merged)).drop("score")


@query(f"WITH {EVENTS_SQL}, t AS (SELECT user_id, k, CASE event_type WHEN 'view' THEN 'B-SUB' WHEN 'click' THEN 'I-SUB' WHEN 'purchase' THEN 'B-ORG' WHEN 'signup' THEN 'I-ORG' ELSE 'O' END AS l, k * 5 AS a, CASE WHEN event_id % 11 = 0 THEN k * 5 ELSE k * 5 + 4 END AS b, value FROM e), z AS (SELECT *, substr(l, 3) AS g FROM t WHERE b > a), f AS (SELECT *, CASE WHEN l = 'O' OR l LIKE 'B%' OR coalesce(lag(g) OVER w, '') <> g THEN 1 ELSE 0 END AS new FROM z WINDOW w AS (PARTITION BY user_id ORDER BY k)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY k) AS island FROM f) SELECT user_id, g AS entity_group, min(a) AS start, max(b) AS \"end\", max(b) - min(a) AS n_chars, round(avg(value), 6) AS score FROM i WHERE l <> 'O' GROUP BY user_id, island, g")
def bio_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("k"), F.col("event_type")
    label = F.when(kind == "view", "B-SUB").when(kind == "click", "I-SUB").when(kind == "purchase", "B-ORG").when(kind == "signup", "I-ORG").otherwise("O")
    token = F.struct(label.alias("label"), F.col("value").alias("score"), (k * 5).alias("start"), F.when(F.col("event_id") % 11 == 0, k * 5).otherwise(k * 5 + 4).alias("end"), F.lit(1).alias("mask"))
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("k", token.alias("t")))).alias("l"))
    found = entities.decode_tags(F.transform("l", lambda x: x["t"]), F.repeat(F.lit("abcde"), F.size("l")))
    return rows.select("user_id", F.inline(found)).select("user_id", "entity_group", "start", "end", F.length("word").alias("n_chars"), F.round("score", 6).alias("score"))


SIDES_SQL = f"{EVENTS_SQL}, s AS (SELECT user_id, event_id, k, k * 7 + event_id % 5 AS finish FROM e WHERE event_type = 'purchase'), o AS (SELECT user_id, k, k * 7 AS start, event_id AS inst FROM e WHERE event_type = 'signup')"


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    orgs = rows.where("event_type = 'signup'").groupBy("user_id").agg(F.collect_list(F.struct((F.col("k") * 7).alias("start"), F.col("k").alias("place"), F.col("event_id").alias("institution_id"))).alias("orgs"))
    return rows.where("event_type = 'purchase'").select("user_id", "event_id", "k", (F.col("k") * 7 + F.col("event_id") % 5).alias("finish")).join(orgs, "user_id", "left")


RIGHT_SQL = f"{SIDES_SQL}, d AS (SELECT s.event_id, first(o.inst ORDER BY o.start) AS inst, min(o.start) - any_value(s.finish) AS gap FROM s JOIN o ON s.user_id = o.user_id AND o.start >= s.finish GROUP BY 1), n AS (SELECT s.event_id, first(o.inst ORDER BY o.k) AS inst, min(o.k) - any_value(s.k) AS gap FROM s JOIN o ON s.user_id = o.user_id AND o.k > s.k GROUP BY 1)"


@query(f"WITH {RIGHT_SQL} SELECT s.event_id, CASE WHEN gap <= 20 THEN inst END AS matched FROM s LEFT JOIN d USING (event_id)")
def nearest_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir).select("event_id", entities.nearest_right(F.col("orgs"), F.col("finish"), 20).alias("matched"))


@query(f"WITH {RIGHT_SQL} SELECT s.event_id, CASE WHEN gap <= 3 THEN inst END AS matched FROM s LEFT JOIN n USING (event_id)")
def next_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir).select("event_id", entities.next_in_order(F.col("orgs"), F.col("k"), 3).alias("matched"))


@query(f"WITH {RIGHT_SQL} SELECT s.event_id, coalesce(CASE WHEN d.gap <= 6 THEN d.inst END, CASE WHEN n.gap <= 3 THEN n.inst END, -1) AS matched FROM s LEFT JOIN d USING (event_id) LEFT JOIN n USING (event_id)")
def attribution_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.coalesce(entities.nearest_right(F.col("orgs"), F.col("finish"), 6), entities.next_in_order(F.col("orgs"), F.col("k"), 3), F.lit(-1))
    return sides(spark, sf_dir).select("event_id", found.alias("matched"))


@query("WITH s AS (SELECT conv_id, turn, trim(text) AS word, length(text) AS n, turn / 10.0e0 AS score FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, score DESC, turn) AS k FROM s WHERE word <> '') SELECT conv_id, k - 1 AS place, word FROM r WHERE k <= greatest(1, conv_id % 4)")
def span_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.struct(F.lit("SPAN").alias("entity_group"), F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("word"), (F.col("turn") / 10.0).alias("score"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", span.alias("s")))).alias("l"))
    chosen = entities.choose_spans(F.transform("l", lambda x: x["s"]), F.col("conv_id") % 4)
    return rows.select("conv_id", F.posexplode(chosen).alias("place", "word")).withColumn("place", F.col("place").cast("long"))


@query("SELECT event_id, coalesce(json_extract(props, '$.k')::INT, 1) AS frequency FROM events")
def json_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.from_json("props", "k int")["k"], F.lit(1)).alias("frequency"))


_KINDS = ("economy", "small", "medium", "promo", "standard", "large", "other")
ATTRIBUTION_SQL = f"""kinds AS (SELECT unnest(range(7)) AS i, unnest({_sql_list(_KINDS)}) AS kind),
raw_names AS (SELECT p_partkey * 4 AS id, 'Department of ' || p_name AS raw FROM part UNION ALL SELECT p_partkey * 4 + 1, 'University of ' || lower(p_type) FROM part UNION ALL SELECT p_partkey * 4 + 2, 'Dept ' || p_name FROM part
  UNION ALL SELECT p_partkey * 4 + 3, 'University of Small' FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT -1 - i, 'University of ' || kind FROM kinds), {DEPT_SQL},
words AS (SELECT id // 4 AS raw_aff_id, id % 4 AS position, raw, CASE WHEN clean = 'dept small ring' THEN 'department of small ring' ELSE clean END AS clean FROM cleaned JOIN raw_names USING (id) WHERE id >= 0 AND clean <> '' AND (id % 4 = 1 OR len(regexp_extract_all(clean, '[^ ]+')) >= 2)),
lists AS (SELECT p_partkey, [p_size % 6, p_size % 6 + 1] AS ids FROM part WHERE p_partkey % 9 <> 0), offers AS (SELECT p_partkey, unnest(ids) AS institution_id, unnest([0, 1]) AS rank FROM lists),
offered AS (SELECT raw_aff_id, words.clean AS a, n.clean AS b, rank, institution_id FROM words JOIN offers ON p_partkey = raw_aff_id JOIN cleaned n ON n.id = -1 - institution_id WHERE position = 1 AND n.clean <> ''),
pairs AS (SELECT DISTINCT a, b FROM offered), {ratio_sql('pairs')},
best AS (SELECT raw_aff_id, first(institution_id ORDER BY score DESC, rank, institution_id DESC) AS found, max(score) AS score FROM offered JOIN rated USING (a, b) GROUP BY 1),
told AS (SELECT words.*, ids, CASE WHEN position = 0 AND score >= 75 THEN found END AS found FROM words JOIN lists ON p_partkey = raw_aff_id LEFT JOIN best USING (raw_aff_id) WHERE position <> 1 AND clean NOT IN (SELECT lower('University of ' || kind) FROM kinds))"""


@query(f"""WITH {ATTRIBUTION_SQL} SELECT raw_aff_id, CASE WHEN found IS NULL THEN array_to_string(ids, ';') ELSE found::VARCHAR END AS institution_ids, CASE WHEN found IS NULL THEN 2 ELSE 1 END AS inst_count,
  raw AS raw_dept_str, clean AS clean_dept_str, position * 5 AS start, position * 5 + length(raw) AS "end", 1 AS frequency FROM told""")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole attribution of entities made of part names, with kinds of parts as candidates."""
    ner, lists, named = ner_tables(spark, sf_dir)
    out = entities.attribute(ner, lists, named, spark.createDataFrame([("dept small ring", "department of small ring")], "abbr_name string, full_name string"))
    return out.withColumn("institution_ids", F.array_join(F.transform("institution_ids", lambda x: x.cast("string")), ";"))


def ner_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    entity = lambda kind, word, start: F.struct(F.lit(kind).alias("entity_group"), word.alias("word"), F.lit(start).alias("start"), (F.lit(start) + F.length(word)).cast("int").alias("end"))
    some = F.array(entity("SUB", F.concat(F.lit("Department of "), F.col("p_name")), 0), entity("ORG", F.concat(F.lit("University of "), F.lower("p_type")), 40), entity("SUB", F.concat(F.lit("Dept "), F.col("p_name")), 10))
    some = F.when(F.col("p_partkey") % 5 == 0, F.concat(some, F.array(entity("SUB", F.lit("University of Small"), 60)))).otherwise(some)
    ner = part.select(F.col("p_partkey").alias("raw_affiliation_string_id"), F.lit(None).cast("long").alias("frequency"), some.alias("entities"))
    lists = part.where("p_partkey % 9 != 0").select(F.col("p_partkey").alias("raw_affiliation_string_id"), F.array(F.col("p_size") % 6, F.col("p_size") % 6 + 1).cast("array<bigint>").alias("institution_ids"))
    kinds = F.array(*[F.lit(x) for x in _KINDS])
    named = spark.range(7).select(F.col("id").alias("institution_id"), F.concat(F.lit("University of "), F.get(kinds, F.col("id").cast("int"))).alias("institution_name"))
    return ner, lists, named


# ---- joins to canonical names and release ----------------------------------------------------------------------------

CANON_SQL = f"{CLUSTERED_SQL}, members AS (SELECT institution_id, name AS member_dept_name, first(name) OVER (PARTITION BY institution_id, cluster ORDER BY frequency DESC, length(name), lower(name), name) AS canonical_dept_name, (sum(frequency) OVER (PARTITION BY institution_id, cluster))::BIGINT AS total FROM clustered), attributed AS (SELECT institution_id, name, frequency FROM names WHERE frequency % 3 <> 0)"


def attached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = names(spark, sf_dir)
    empty = F.lit(None).cast("int")
    detailed = rows.select(F.col("frequency").alias("raw_aff_id"), F.array("institution_id").alias("institution_ids"), F.when(F.col("frequency") % 3 == 0, 2).otherwise(1).alias("inst_count"), F.col("name").alias("raw_dept_str"), F.col("name").alias("clean_dept_str"), empty.alias("start"), empty.alias("end"), "frequency")
    return detailed, canonical.attach_canonical(detailed, cluster_members(spark, sf_dir))


@query(f"WITH {CANON_SQL} SELECT frequency AS raw_affiliation_id, a.institution_id, name AS clean_dept_str, frequency, canonical_dept_name, total AS cluster_total_frequency FROM attributed a JOIN members m ON a.institution_id = m.institution_id AND a.name = m.member_dept_name")
def canonical_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attached(spark, sf_dir)[1].drop("raw_dept_str", "start", "end")


@query(f"WITH {CANON_SQL} SELECT (SELECT count(*) FROM attributed) AS kept_rows, (SELECT count(*) FROM names) AS all_rows, round((SELECT count(*) FROM attributed)::DOUBLE / (SELECT count(*) FROM names), 9) AS ratio")
def match_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    detailed, kept = attached(spark, sf_dir)
    return canonical.match_ratio(detailed, kept).withColumn("ratio", F.round("ratio", 9))


@query(f"WITH {CANON_SQL} SELECT institution_id, name AS clean_dept_str, sum(frequency)::BIGINT AS frequency FROM attributed GROUP BY 1, 2")
def dedupe_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.dedupe_input(attached(spark, sf_dir)[0])


RELEASE_SQL = f"""{TREE_SQL}, edu AS (SELECT institution_id FROM inst WHERE n_regionkey IN (0, 1, 3)), h AS (SELECT tree.* FROM tree JOIN edu USING (institution_id)),
valid AS (SELECT institution_id, parent_name AS name FROM h UNION SELECT institution_id, child_name FROM h), r AS (SELECT base.* FROM base JOIN edu USING (institution_id) JOIN valid ON base.institution_id = valid.institution_id AND base.canonical_dept_name = valid.name),
rootlike AS (SELECT DISTINCT c.institution_id, c.name FROM (SELECT institution_id, name FROM valid UNION SELECT institution_id, canonical_dept_name FROM r) c JOIN inst ON c.institution_id = inst.institution_id AND lower(c.name) = lower(inst.institution_name)),
r2 AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM rootlike x WHERE x.institution_id = r.institution_id AND x.name = r.canonical_dept_name)),
h2 AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM rootlike x WHERE x.institution_id = h.institution_id AND x.name = h.child_name) AND (parent_name = institution_name OR NOT EXISTS (SELECT 1 FROM rootlike x WHERE x.institution_id = h.institution_id AND x.name = h.parent_name))),
pool AS (SELECT institution_id, parent_name AS canonical_name FROM h2 WHERE parent_name <> institution_name UNION SELECT institution_id, child_name FROM h2 UNION SELECT institution_id, canonical_dept_name FROM r2),
subs AS (SELECT row_number() OVER (ORDER BY institution_id, canonical_name) AS sub_institution_id, institution_id, canonical_name FROM pool)"""


def released(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    plain = stage_table(base(spark, sf_dir), "base")
    rows = plain.withColumn("raw_dept_str", F.upper("canonical_dept_name"))
    named = institutions(spark, sf_dir)
    strings = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("raw_affiliation_string_id"), F.col("o_orderpriority").alias("raw_affiliation_string"))
    return release.release(rows, tree(spark, sf_dir, plain), named, named.where("institution_type_id in (0, 1, 3)").select("institution_id"), strings)


@query(f"{RELEASE_SQL} SELECT sub_institution_id, institution_id, canonical_name FROM subs")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return released(spark, sf_dir)["sub_institutions"]


@query(f"{RELEASE_SQL} SELECT DISTINCT raw_affiliation_id AS raw_affiliation_string_id, r2.institution_id, sub_institution_id, upper(canonical_dept_name) AS raw_sub_institution_name FROM r2 JOIN subs ON r2.institution_id = subs.institution_id AND canonical_dept_name = canonical_name")
def release_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return released(spark, sf_dir)["mappings"]


@query(f"{RELEASE_SQL} SELECT DISTINCT h2.institution_id, CASE WHEN parent_name <> institution_name THEN p.sub_institution_id END AS parent_sub_institution_id, c.sub_institution_id AS child_sub_institution_id FROM h2 LEFT JOIN subs p ON h2.institution_id = p.institution_id AND parent_name = p.canonical_name LEFT JOIN subs c ON h2.institution_id = c.institution_id AND child_name = c.canonical_name")
def release_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return released(spark, sf_dir)["hierarchy"]


@query(f"{RELEASE_SQL} SELECT DISTINCT inst.institution_id, institution_name FROM inst JOIN pool USING (institution_id)")
def release_institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return released(spark, sf_dir)["institutions"]


@query(f"{RELEASE_SQL} SELECT DISTINCT o_orderkey AS raw_affiliation_string_id, o_orderpriority AS raw_affiliation_string FROM orders JOIN r2 ON o_orderkey = raw_affiliation_id")
def raw_string_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return released(spark, sf_dir)["raw_affiliation_strings"]


@query(f"{RELEASE_SQL} SELECT institution_id, canonical_dept_name, count(*) AS n_rows FROM r2 GROUP BY 1, 2")
def anti_join_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = institutions(spark, sf_dir)
    education = named.where("institution_type_id in (0, 1, 3)").select("institution_id")
    plain = stage_table(base(spark, sf_dir), "base")
    rows, links = plain.join(education, "institution_id", "left_semi"), tree(spark, sf_dir, plain).join(education, "institution_id", "left_semi")
    valid = links.select("institution_id", F.col("parent_name").alias("canonical_dept_name")).union(links.select("institution_id", "child_name")).distinct()
    kept, _ = release.drop_root_like(rows.join(valid, ["institution_id", "canonical_dept_name"], "left_semi").select(*rows.columns), links, named)
    return kept.groupBy("institution_id", "canonical_dept_name").agg(F.count(F.lit(1)).alias("n_rows"))


@query()
def full_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on strings made of part and supplier rows; the hierarchy with names instead of ids."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("Department of "), F.col("p_name"), F.lit(", School of "), F.lower("p_type"), F.lit(", University of "), F.lower("p_brand"), F.lit(" the of and in"))
    strings = part.select(F.col("p_partkey").alias("raw_affiliation_string_id"), text.alias("raw_affiliation_string"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work_id"), F.col("l_linenumber").alias("affiliation_seq"), F.col("l_partkey").alias("raw_affiliation_string_id"), F.col("l_suppkey").alias("institution_id"))
    named = supplier.select(F.col("s_suppkey").alias("institution_id"), F.concat(F.lit("University of Brand#"), F.col("s_suppkey").cast("string")).alias("institution_name"), F.lit(3).alias("institution_type_id"))
    tables = {"work_affiliation": lines.drop("institution_id"), "work_affiliation_institution": lines.drop("raw_affiliation_string_id"), "raw_affiliation_string": strings, "institution": named, "abbreviations": spark.createDataFrame([("dept", "department")], "abbr_name string, full_name string")}
    out = Pipeline().run(tables)
    subs = out["sub_institutions"]
    child = subs.select("institution_id", F.col("sub_institution_id").alias("child_sub_institution_id"), F.col("canonical_name").alias("child"))
    parent = subs.select(F.col("sub_institution_id").alias("parent_sub_institution_id"), F.col("canonical_name").alias("parent"))
    return out["hierarchy"].join(child, ["institution_id", "child_sub_institution_id"]).join(parent, "parent_sub_institution_id", "left").select("institution_id", "parent", "child")
