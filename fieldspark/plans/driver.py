"""Driver queries: the pipelines run over the benchmark tables.

How the benchmark tables stand in for the field data
----------------------------------------------------
* Diet (D): ``lineitem`` joined to ``part``.  Fish id = ``l_orderkey``,
  species = ``p_type``, sampling date = quarter of ``l_shipdate``, prey =
  ``p_name`` (two words: taxon and stage), diet mass = ``l_extendedprice``.
* Counts (C): ``events`` per day and ``event_type``.
* Wide counts (E): ``lineitem`` columns ``l_quantity``, ``l_tax``,
  ``l_discount`` as per-sample counts of three taxa.
* Draws (X): ``embeddings``; draw = ``vec_id``, coefficient vector =
  ``embedding``.
* Response (V): ``events.value``.

Every query reads whole tables; the only row cut is ``thin_draws`` (the
operator itself keeps the first draws).  Each query except the four that
draw random numbers has an equivalent DuckDB SQL text in ``ORACLE_SQL``;
floating outputs are rounded to 6 decimals (2 for large money-like sums)
on both sides so engine-specific last-bit differences do not change the
comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.operators.aggregate import strict_sum
from fieldspark.plans.diet import (
    add_diet_measures,
    classify_stage,
    clean_prey_names,
    diet_posteriors,
    diet_stage_totals,
)
from fieldspark.plans.summaries import species_means_bydate, species_means_global
from fieldspark.sources.readers import read_table

DIGITS = 6
SEED = 2020

# ---- fixed parameters of the stand-in analysis ---------------------------
# Species dropped, species renamed (first match), prey renames
# applied in order, stage renames, stages counted as "pa".
DROP_SPECIES = ["PROMO"]
SPECIES_RULES = [("ECONOMY", "BUDGET")]
PREY_RULES = [("small", "little"), ("large", "big"), ("little", "tiny")]
STAGE_RULES = {"ring": "r"}
PA_STAGES = ["bolt", "gear"]
# Display names of the draw-model species.
SPECIES_NAMES = {"click": "Click", "view": "View", "purchase": "Purchase", "signup": "Signup",
                 "error": "Error"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def rounded(df: DataFrame, digits: int = DIGITS, **per_column: int) -> DataFrame:
    """Round floating columns for engine-independent comparison.

    Large sums of money-like values carry summation-order noise in their
    last bits, so they are given fewer digits via ``per_column``.
    """
    return df.select(*[
        F.round(F.col(f.name), per_column.get(f.name, digits)).alias(f.name)
        if f.dataType.typeName() in ("double", "float") else F.col(f.name)
        for f in df.schema.fields
    ])


# ---- stand-in tables -------------------------------------------------------

def prey_dimension(spark: SparkSession, base: str) -> DataFrame:
    """Per-part attributes under diet names (species, prey, prey mass)."""
    pt = read_table(spark, base, "part")
    return pt.select("p_partkey", F.col("p_type").alias("species"),
                     F.col("p_name").alias("prey_taxon"), F.col("p_retailprice").alias("prey_mg_dm"))


def observations(spark: SparkSession, base: str) -> DataFrame:
    li = read_table(spark, base, "lineitem")
    return li.select(F.col("l_orderkey").alias("id"), "l_partkey",
                     F.date_trunc("quarter", "l_shipdate").cast("date").alias("date2"),
                     F.col("l_extendedprice").alias("mg_diet_dm"))


def join_prey(obs: DataFrame, dim: DataFrame) -> DataFrame:
    j = obs.join(dim, obs.l_partkey == dim.p_partkey)
    extra = ["prey_stage"] if "prey_stage" in dim.columns else []
    return j.select("id", "species", "date2", "prey_taxon", "mg_diet_dm", "prey_mg_dm", *extra)


def diet_table(spark: SparkSession, base: str) -> DataFrame:
    """Diet observations from lineitem x part (join on the part key)."""
    return join_prey(observations(spark, base), prey_dimension(spark, base))


DIET_SQL = """
diet AS (
  SELECT l.l_orderkey AS id, p.p_type AS species,
         CAST(date_trunc('quarter', l.l_shipdate) AS DATE) AS date2,
         p.p_name AS prey_taxon, l.l_extendedprice AS mg_diet_dm, p.p_retailprice AS prey_mg_dm
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
)"""

CLEAN_SQL = DIET_SQL + """,
d0 AS (
  SELECT *, 0.01 + mg_diet_dm AS mgdm01,
         regexp_replace(species, 'ECONOMY', 'BUDGET') AS species_r,
         regexp_replace(regexp_replace(regexp_replace(prey_taxon, 'small', 'little', 'g'),
                        'large', 'big', 'g'), 'little', 'tiny', 'g') AS prey_r
  FROM diet WHERE species NOT IN ('PROMO')
),
d1 AS (
  SELECT *, regexp_split_to_array(prey_r, '[^A-Za-z0-9]+') AS parts FROM d0
),
d AS (
  SELECT id, species_r AS species, date2,
         parts[1] || '_' || trim(CASE WHEN parts[2] = 'ring' THEN 'r'
                                      WHEN parts[2] IS NULL THEN 'unknown'
                                      ELSE parts[2] END) AS prey_taxon,
         mg_diet_dm, prey_mg_dm, mgdm01
  FROM d1
)"""


def clean_diet_table(spark: SparkSession, base: str, classify: bool = False) -> DataFrame:
    """D1 with the name cleaning pushed to the part side of the join.

    Same result as ``clean_diet`` on the joined table; the regular
    expressions run per part instead of per line item, and dropped
    species never reach the join.
    """
    dim = clean_prey_names(prey_dimension(spark, base), DROP_SPECIES, SPECIES_RULES, PREY_RULES,
                           STAGE_RULES)
    if classify:
        dim = classify_stage(dim, PA_STAGES)
    return add_diet_measures(join_prey(observations(spark, base), dim))


def diet_by_part(spark: SparkSession, base: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Diet mass summed per part (and ``extra`` observation keys), then named.

    For results that only need sums per prey and species, the line items
    are aggregated by part key *before* the join (partial aggregation, one
    shuffle of part-level sums), so the join sees one row per part instead
    of one per line item; Catalyst does not move aggregates below joins by
    itself.  Sums of these sums equal the sums over the joined
    observations.  (Measured at sf0.1 this is also faster than joining
    first with a broadcast of the part table.)
    """
    obs = observations(spark, base)
    per_part = obs.groupBy("l_partkey", *extra).agg(strict_sum("mg_diet_dm").alias("mg_diet_dm"))
    dim = clean_prey_names(prey_dimension(spark, base), DROP_SPECIES, SPECIES_RULES, PREY_RULES,
                           STAGE_RULES)
    j = per_part.join(dim, per_part.l_partkey == dim.p_partkey)
    return j.select("species", "prey_taxon", *extra, "mg_diet_dm")


def draw_cells(spark: SparkSession, base: str) -> DataFrame:
    """Observation cells of the draw model: species x week x stage class."""
    ev = read_table(spark, base, "events")
    return ev.select(F.col("event_type").alias("species"),
                     F.date_trunc("week", "ts").cast("date").alias("date2"),
                     F.when(F.col("value") >= 50, F.lit("pa")).otherwise(F.lit("not_pa"))
                     .alias("prey_stage"))


def draws_table(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "embeddings").select(F.col("vec_id").alias("draw"),
                                                        F.col("embedding").alias("coef"))


def draw_grid(spark: SparkSession, base: str) -> DataFrame:
    """Observed cells with the abundance of their (date, species), one aggregate.

    Per (date, species): events of each stage class and in total.  The two
    stage cells are exploded from that row and kept where observed, so
    cells and abundance come from one group-by (one shuffle) and are
    distinct by construction.
    """
    c = draw_cells(spark, base)
    g = c.groupBy("date2", "species").agg(
        F.count(F.when(F.col("prey_stage") == "pa", F.lit(1))).alias("n_pa"),
        F.count(F.when(F.col("prey_stage") == "not_pa", F.lit(1))).alias("n_np"),
        F.count(F.lit(1)).cast("double").alias("total_abund"))
    stages = F.array(F.struct(F.lit("pa").alias("prey_stage"), F.col("n_pa").alias("n")),
                     F.struct(F.lit("not_pa").alias("prey_stage"), F.col("n_np").alias("n")))
    e = g.select("species", "date2", "total_abund", F.explode(stages).alias("__s"))
    return e.where(F.col("__s.n") > 0).select("species", "date2", F.col("__s.prey_stage")
                                               .alias("prey_stage"), "total_abund")


def diet_posts(spark: SparkSession, base: str) -> DataFrame:
    return diet_posteriors(draws_table(spark, base), grid=draw_grid(spark, base),
                           species_names=SPECIES_NAMES, grid_is_distinct=True)


POSTS_SQL = """
ev AS (
  SELECT event_type AS species, CAST(date_trunc('week', ts) AS DATE) AS date2,
         CASE WHEN value >= 50 THEN 'pa' ELSE 'not_pa' END AS prey_stage
  FROM events
),
cells AS (
  SELECT species, date2, prey_stage,
         row_number() OVER (ORDER BY species, date2, prey_stage) - 1 AS cell_index
  FROM (SELECT DISTINCT species, date2, prey_stage FROM ev)
),
ab AS (SELECT date2, species, CAST(count(*) AS DOUBLE) AS total_abund FROM ev GROUP BY date2, species),
ep AS (
  SELECT c.species, c.date2, c.prey_stage, e.vec_id AS draw,
         exp(CAST(e.embedding[c.cell_index + 1] AS DOUBLE)) AS epred,
         exp(CAST(e.embedding[c.cell_index + 1] AS DOUBLE)) * ab.total_abund AS population_epred
  FROM cells c LEFT JOIN ab ON c.date2 = ab.date2 AND c.species = ab.species
  CROSS JOIN embeddings e
),
wide AS (
  SELECT date2, species, draw,
         coalesce(sum(CASE WHEN prey_stage = 'pa' THEN epred END), 0) AS pa_c,
         coalesce(sum(CASE WHEN prey_stage = 'not_pa' THEN epred END), 0) AS np_c,
         coalesce(sum(CASE WHEN prey_stage = 'pa' THEN population_epred END), 0) AS pa_p,
         coalesce(sum(CASE WHEN prey_stage = 'not_pa' THEN population_epred END), 0) AS np_p
  FROM ep GROUP BY date2, species, draw
),
lv AS (
  SELECT date2, species, draw, 'Per capita' AS data_level, pa_c AS pa, np_c AS not_pa FROM wide
  UNION ALL
  SELECT date2, species, draw, 'Per population', pa_p, np_p FROM wide
),
lv2 AS (
  SELECT date2, species, draw, data_level, pa, not_pa, pa + not_pa AS total,
         CASE WHEN pa + not_pa = 0 THEN NULL ELSE pa / (pa + not_pa) END AS prop_pa
  FROM lv
),
comm AS (
  SELECT date2, draw, sum(pa) AS pa, sum(total) AS total, sum(not_pa) AS not_pa
  FROM lv2 WHERE data_level = 'Per population' GROUP BY date2, draw
),
posts0 AS (
  SELECT date2, species, draw, data_level, pa, not_pa, total, prop_pa FROM lv2
  UNION ALL
  SELECT date2, 'Community', draw, 'Per community', pa, not_pa, total,
         CASE WHEN total = 0 THEN NULL ELSE pa / total END FROM comm
),
posts AS (
  SELECT date2, CASE species WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View'
                     WHEN 'purchase' THEN 'Purchase' WHEN 'signup' THEN 'Signup'
                     WHEN 'error' THEN 'Error' ELSE species END AS species,
         draw, data_level, pa, not_pa, total, prop_pa
  FROM posts0
)"""


# ---- queries ---------------------------------------------------------------

@query("stage_totals", "WITH " + CLEAN_SQL + """
SELECT id, species, date2,
       CASE WHEN split_part(prey_taxon, '_', 2) IN ('bolt', 'gear') THEN 'pa' ELSE 'not_pa' END
         AS prey_stage,
       round(sum(mg_diet_dm), 6) AS mg_dmtotal
FROM d GROUP BY ALL
""")
def q_stage_totals(spark: SparkSession, base: str) -> DataFrame:
    return rounded(diet_stage_totals(clean_diet_table(spark, base, classify=True),
                                     PA_STAGES))


@query("summarize_draws", "WITH " + POSTS_SQL + """,
lng AS (
  SELECT data_level, species, date2, draw, 'prop_pa' AS name, prop_pa AS value FROM posts
  UNION ALL
  SELECT data_level, species, date2, draw, 'total', total FROM posts
),
avg_all AS (
  SELECT data_level, 'All Species' AS species, draw, name, avg(value) AS value
  FROM lng GROUP BY data_level, draw, name
  UNION ALL
  SELECT data_level, species, draw, name, avg(value) FROM lng GROUP BY data_level, species, draw, name
),
sc AS (SELECT *, CASE WHEN name = 'total' THEN value * 1000 ELSE value END AS v FROM avg_all)
SELECT data_level, species, name,
       round(CASE WHEN count(*) = count(v) THEN median(v) END, 2) AS median,
       round(CASE WHEN count(*) = count(v) THEN avg(v) END, 2) AS mean,
       round(CASE WHEN count(*) = count(v) THEN stddev_samp(v) END, 2) AS sd,
       round(quantile_cont(v, 0.025), 2) AS lower,
       round(quantile_cont(v, 0.975), 2) AS upper
FROM sc GROUP BY data_level, species, name
""")
def q_summarize_draws(spark: SparkSession, base: str) -> DataFrame:
    return species_means_global(diet_posts(spark, base), scale={"total": 1000.0})


@query("summarize_draws_bydate", "WITH " + POSTS_SQL + """,
lng AS (
  SELECT data_level, species, date2, draw, 'prop_pa' AS name, prop_pa AS value FROM posts
  UNION ALL
  SELECT data_level, species, date2, draw, 'total', total FROM posts
),
both_ AS (
  SELECT data_level, date2, 'All Species' AS species, draw, name, avg(value) AS value
  FROM lng GROUP BY data_level, date2, draw, name
  UNION ALL
  SELECT data_level, date2, species, draw, name, value FROM lng
),
sc AS (SELECT *, CASE WHEN name = 'total' THEN value * 1000 ELSE value END AS v FROM both_)
SELECT data_level, date2, species, name,
       round(CASE WHEN count(*) = count(v) THEN median(v) END, 2) AS median,
       round(CASE WHEN count(*) = count(v) THEN avg(v) END, 2) AS mean,
       round(CASE WHEN count(*) = count(v) THEN stddev_samp(v) END, 2) AS sd,
       round(quantile_cont(v, 0.025), 2) AS lower,
       round(quantile_cont(v, 0.975), 2) AS upper
FROM sc GROUP BY data_level, date2, species, name
""")
def q_summarize_draws_bydate(spark: SparkSession, base: str) -> DataFrame:
    return species_means_bydate(diet_posts(spark, base), scale={"total": 1000.0})


# ---- diet family (D) -------------------------------------------------------

# Resources left out of the food web, resources drawn at other
# heights, the colour pattern and names, the label pattern and labels.
WEB_EXCLUDE = ["blue_rod", "red_rod"]
WEB_SPECIAL_Y = {"hot_gear": 1.5, "cold_gear": 0.5}
WEB_COLOUR = ("blue", ("blue", "non-blue"))
WEB_RESOURCE_FIRST = ["tiny_r", "hot_gear"]
WEB_LABELS = {"blue-bolt": "blue bolts", "tiny-r": "tiny rings", "hot-gear": "hot gears"}
LUMP_THRESHOLD = 0.016
LUMP_KEEP = ["hot_rod"]
SPECIES_FIRST = ["SMALL", "STANDARD"]

WEB_SQL = CLEAN_SQL + """,
sp AS (SELECT species, sum(mg_diet_dm) AS total_gdm FROM d GROUP BY species),
st AS (SELECT species, prey_taxon, sum(mg_diet_dm) AS total_gdm_taxa FROM d GROUP BY species, prey_taxon),
props AS (
  SELECT st.species AS consumer, st.prey_taxon AS resource,
         st.total_gdm_taxa / sp.total_gdm AS diet_post
  FROM st JOIN sp USING (species)
  WHERE st.prey_taxon NOT IN ('blue_rod', 'red_rod')
),
codes AS (
  SELECT *, dense_rank() OVER (ORDER BY consumer) AS cc,
         dense_rank() OVER (ORDER BY CASE resource WHEN 'tiny_r' THEN 0 WHEN 'hot_gear' THEN 1
                                     ELSE 2 END, resource) AS rc,
         count(DISTINCT consumer) OVER () AS nc, count(DISTINCT resource) OVER () AS nr
  FROM props
),
edges AS (
  SELECT resource, consumer, diet_post,
         CASE WHEN nc = 1 THEN 0.5 ELSE (cc - 1) / (nc - 1) * 0.5 + 0.25 END AS xend,
         CASE WHEN nr = 1 THEN 0.5 ELSE (rc - 1) / (nr - 1) * 1.0 + 0.0 END AS x,
         CAST(0.0 AS DOUBLE) AS "offset",
         CAST(CASE WHEN resource = 'hot_gear' THEN 1.5 WHEN resource = 'cold_gear' THEN 0.5
                   ELSE 1.0 END AS DOUBLE) AS y,
         CAST(2.0 AS DOUBLE) AS yend,
         CASE WHEN resource LIKE '%blue%' THEN 'blue' ELSE 'non-blue' END AS color
  FROM codes
),
nodes AS (
  SELECT regexp_replace(resource, '_', '-') AS taxon, 'resource' AS trophic, x, y FROM edges
  UNION ALL
  SELECT consumer, 'consumer', xend, yend FROM edges
),
nodes2 AS (
  SELECT taxon, trophic, x, y,
         CASE WHEN taxon LIKE '%blue%' THEN 'blue' ELSE 'non-blue' END AS color,
         regexp_split_to_array(taxon, '[^A-Za-z0-9]+')[1] AS taxon_ungrouped,
         coalesce(regexp_split_to_array(taxon, '[^A-Za-z0-9]+')[2], 'unknown') AS stage
  FROM nodes
)"""


def food_web_props(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.plans.foodweb import diet_proportions

    return diet_proportions(diet_by_part(spark, base), WEB_EXCLUDE)


def food_web_edges(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.plans.foodweb import edge_table

    return edge_table(food_web_props(spark, base), WEB_SPECIAL_Y, WEB_COLOUR[0], WEB_COLOUR[1],
                      resource_first=WEB_RESOURCE_FIRST)


@query("separate_stage", """
WITH p AS (
  SELECT p_partkey, CASE WHEN p_size > 40 THEN p_type ELSE p_name END AS prey_raw FROM part
),
s AS (
  SELECT p_partkey, prey_raw, regexp_split_to_array(prey_raw, '[^A-Za-z0-9]+') AS parts FROM p
)
SELECT p_partkey, parts[1] AS prey_taxon,
       trim(CASE WHEN parts[2] = 'ring' THEN 'r' WHEN parts[2] IS NULL THEN 'unknown'
                 ELSE parts[2] END) AS prey_stage,
       coalesce(parts[1], 'NA') || '_' ||
         trim(CASE WHEN parts[2] = 'ring' THEN 'r' WHEN parts[2] IS NULL THEN 'unknown'
                   ELSE parts[2] END) AS prey_united
FROM s
""")
def q_separate_stage(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.functions.conditionals import case_when
    from fieldspark.functions.strings import separate_parts, unite_cols

    p = read_table(spark, base, "part").select(
        "p_partkey", F.when(F.col("p_size") > 40, F.col("p_type")).otherwise(F.col("p_name"))
        .alias("prey_raw"))
    taxon, stage = separate_parts("prey_raw", 2)
    stage_n = F.trim(case_when([(stage == "ring", F.lit("r")), (stage.isNull(), F.lit("unknown"))],
                               stage))
    return p.select("p_partkey", taxon.alias("prey_taxon"), stage_n.alias("prey_stage"),
                    unite_cols([taxon, stage_n]).alias("prey_united"))


@query("string_recode", """
SELECT p_partkey,
       regexp_replace(p_name, 'o', '0') AS first_o,
       regexp_replace(regexp_replace(regexp_replace(p_name, 'small', 'little', 'g'),
                      'large', 'big', 'g'), 'little', 'tiny', 'g') AS recoded,
       lower(regexp_replace(p_brand, 'Brand#', '')) AS brand_no,
       trim('  ' || p_type || ' ') AS type_trim,
       length(p_name) AS name_len,
       p_type || '_' || CAST(p_size AS VARCHAR) AS type_size
FROM part
""")
def q_string_recode(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.functions.strings import remove_first, replace_all_ordered, replace_first

    p = read_table(spark, base, "part")
    return p.select(
        "p_partkey",
        replace_first("p_name", "o", "0").alias("first_o"),
        replace_all_ordered("p_name", PREY_RULES).alias("recoded"),
        F.lower(remove_first("p_brand", "Brand#")).alias("brand_no"),
        F.trim(F.concat(F.lit("  "), F.col("p_type"), F.lit(" "))).alias("type_trim"),
        F.length("p_name").cast("bigint").alias("name_len"),
        F.concat(F.col("p_type"), F.lit("_"), F.col("p_size").cast("string")).alias("type_size"),
    )


@query("pivot_stage", "WITH " + CLEAN_SQL + """,
t AS (
  SELECT id, species, date2,
         CASE WHEN split_part(prey_taxon, '_', 2) IN ('bolt', 'gear') THEN 'pa' ELSE 'not_pa' END
           AS prey_stage, sum(mg_diet_dm) AS mg_dmtotal
  FROM d GROUP BY ALL
),
w AS (
  SELECT id, species, date2,
         coalesce(sum(CASE WHEN prey_stage = 'pa' THEN mg_dmtotal END), 0) AS pa,
         coalesce(sum(CASE WHEN prey_stage = 'not_pa' THEN mg_dmtotal END), 0) AS not_pa
  FROM t GROUP BY id, species, date2
)
SELECT id, species, date2, round(pa, 6) AS pa, round(not_pa, 6) AS not_pa,
       round(pa + not_pa, 6) AS total,
       round(CASE WHEN pa + not_pa = 0 THEN NULL ELSE pa / (pa + not_pa) END, 6) AS prop_pa
FROM w
""")
def q_pivot_stage(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.plans.diet import diet_stage_wide

    return rounded(diet_stage_wide(clean_diet_table(spark, base, classify=True), PA_STAGES))


@query("bind_levels", "WITH " + CLEAN_SQL + """
SELECT 'Per species' AS data_level, species, date2, round(sum(mg_diet_dm), 2) AS total
FROM d GROUP BY species, date2
UNION ALL
SELECT 'Per community', NULL, date2, round(sum(mg_diet_dm), 2) FROM d GROUP BY date2
""")
def q_bind_levels(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.reshape import bind_rows

    # the community totals are sums of the species totals: one scan, one join
    per_sp = diet_by_part(spark, base, ("date2",)).groupBy("species", "date2").agg(
        strict_sum("mg_diet_dm").alias("total"))
    comm = per_sp.groupBy("date2").agg(strict_sum("total").alias("total")) \
        .withColumn("data_level", F.lit("Per community"))
    per_sp = per_sp.withColumn("data_level", F.lit("Per species"))
    return rounded(bind_rows(per_sp, comm).select("data_level", "species", "date2", "total"), 2)


@query("share_of_total", "WITH " + CLEAN_SQL + """,
g AS (SELECT prey_taxon, sum(mg_diet_dm) AS total FROM d GROUP BY prey_taxon)
SELECT prey_taxon, round(total, 2) AS total, round(sum(total) OVER (), 2) AS global,
       round(total / sum(total) OVER (), 6) AS proportion
FROM g
""")
def q_share_of_total(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.aggregate import share_of_total

    return rounded(share_of_total(diet_by_part(spark, base), ["prey_taxon"], "mg_diet_dm"),
                   total=2, **{"global": 2})


@query("lump_rare", "WITH " + CLEAN_SQL + """,
g AS (SELECT prey_taxon, sum(mg_diet_dm) AS total FROM d GROUP BY prey_taxon),
m AS (
  SELECT prey_taxon,
         CASE WHEN total / sum(total) OVER () >= 0.016 OR prey_taxon IN ('hot_rod') THEN prey_taxon
              ELSE 'other_unknown' END AS prey_taxon_grouped
  FROM g
)
SELECT date2, species, prey_taxon_grouped, id, round(sum(mg_diet_dm), 6) AS mg_diet_dm,
       round(sum(mg_diet_dm) + 0.1, 6) AS mg_diet_dm01
FROM d LEFT JOIN m USING (prey_taxon)
GROUP BY date2, species, prey_taxon_grouped, id
""")
def q_lump_rare(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.plans.diet import lump_rare_prey

    return rounded(lump_rare_prey(clean_diet_table(spark, base), LUMP_THRESHOLD, LUMP_KEEP))


@query("diet_proportion", "WITH " + CLEAN_SQL + """,
sp AS (SELECT species, sum(mg_diet_dm) AS total_gdm FROM d GROUP BY species),
st AS (SELECT species, prey_taxon, sum(mg_diet_dm) AS total_gdm_taxa FROM d GROUP BY species, prey_taxon)
SELECT species, prey_taxon, round(total_gdm, 2) AS total_gdm,
       round(total_gdm_taxa, 2) AS total_gdm_taxa,
       round(total_gdm_taxa / total_gdm, 6) AS proportion
FROM st JOIN sp USING (species)
""")
def q_diet_proportion(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.aggregate import proportion_within

    return rounded(proportion_within(diet_by_part(spark, base), ["species"], ["prey_taxon"],
                                     "mg_diet_dm"), total_gdm=2, total_gdm_taxa=2)


@query("rank_by_mean", "WITH " + CLEAN_SQL + """,
m AS (SELECT prey_taxon, avg(mg_diet_dm) AS mean_value FROM d GROUP BY prey_taxon)
SELECT prey_taxon, round(mean_value, 6) AS mean_value,
       row_number() OVER (ORDER BY mean_value DESC NULLS LAST, prey_taxon) AS level
FROM m
""")
def q_rank_by_mean(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.aggregate import rank_by_mean

    return rounded(rank_by_mean(clean_diet_table(spark, base), "prey_taxon", "mg_diet_dm"))


@query("relevel_sort", "WITH " + CLEAN_SQL + """,
s AS (SELECT DISTINCT species FROM d)
SELECT species,
       CAST(CASE WHEN species = 'SMALL' THEN 1 WHEN species = 'STANDARD' THEN 2
            ELSE 2 + row_number() OVER (PARTITION BY species IN ('SMALL', 'STANDARD') ORDER BY species)
            END AS INTEGER) AS species_level
FROM s
""")
def q_relevel_sort(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.window import relevel_key

    s = clean_diet_table(spark, base).select("species").distinct()
    return relevel_key(s, "species", SPECIES_FIRST, "species_level")


@query("rescale_layout", "WITH " + WEB_SQL + """
SELECT DISTINCT 'consumer' AS role, consumer AS name, round(xend, 6) AS pos FROM edges
UNION ALL
SELECT DISTINCT 'resource', resource, round(x, 6) FROM edges
""")
def q_rescale_layout(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.plans.foodweb import layout

    lay = layout(food_web_props(spark, base), resource_first=WEB_RESOURCE_FIRST)
    both = F.array(F.struct(F.lit("consumer").alias("role"), F.col("consumer").alias("name"),
                            F.col("xend").alias("pos")),
                   F.struct(F.lit("resource").alias("role"), F.col("resource").alias("name"),
                            F.col("x").alias("pos")))
    return rounded(lay.select(F.explode(both).alias("r")).select("r.*").distinct())


@query("edge_table", "WITH " + WEB_SQL + """
SELECT resource, consumer, round(diet_post, 6) AS diet_post, round(xend, 6) AS xend,
       round(x, 6) AS x, round(x + "offset", 6) AS x1, round(xend + "offset", 6) AS xend1,
       round(diet_post * 100, 6) AS repeats, y, yend, color
FROM edges
""")
def q_edge_table(spark: SparkSession, base: str) -> DataFrame:
    e = food_web_edges(spark, base)
    return rounded(e.select("resource", "consumer", "diet_post", "xend", "x", "x1", "xend1",
                            "repeats", "y", "yend", "color"))


@query("node_table", "WITH " + WEB_SQL + """
SELECT taxon, trophic, round(x, 6) AS x, round(y, 6) AS y, color, taxon_ungrouped, stage
FROM nodes2
""")
def q_node_table(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.plans.foodweb import node_table

    return rounded(node_table(food_web_edges(spark, base), "blue", WEB_COLOUR[1]))


@query("node_labels", "WITH " + WEB_SQL + """,
f AS (
  SELECT * FROM nodes2
  QUALIFY row_number() OVER (PARTITION BY taxon ORDER BY trophic <> 'resource', x, y) = 1
)
SELECT taxon, trophic, round(x, 6) AS x, round(y, 6) AS y, color, taxon_ungrouped, stage,
       CASE WHEN taxon LIKE '%blue%' THEN taxon END AS prey_label,
       CASE WHEN taxon = 'blue-bolt' THEN 'blue bolts' WHEN taxon = 'tiny-r' THEN 'tiny rings'
            WHEN taxon = 'hot-gear' THEN 'hot gears' END AS label
FROM f
""")
def q_node_labels(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.plans.foodweb import node_labels, node_table

    nodes = node_table(food_web_edges(spark, base), "blue", WEB_COLOUR[1])
    return rounded(node_labels(nodes, "blue", WEB_LABELS))


@query("taxon_totals", "WITH " + CLEAN_SQL + """
SELECT id, species, date2, round(sum(mg_diet_dm), 6) AS mg_dm, 'All prey' AS "group"
FROM d GROUP BY id, species, date2
UNION ALL
SELECT id, species, date2, round(sum(mg_diet_dm), 6), 'Tiny prey'
FROM d WHERE prey_taxon LIKE 'tiny\\_%' ESCAPE '\\' GROUP BY id, species, date2
""")
def q_taxon_totals(spark: SparkSession, base: str) -> DataFrame:
    # both groups from one conditional aggregate
    d = clean_diet_table(spark, base)
    tiny = F.col("prey_taxon").startswith("tiny_")
    sums = d.groupBy("id", "species", "date2").agg(
        strict_sum("mg_diet_dm").alias("all"), F.count(F.when(tiny, F.lit(1))).alias("n"),
        F.sum(F.when(tiny, F.col("mg_diet_dm"))).alias("tiny"))
    groups = F.array(F.struct(F.lit("All prey").alias("group"), F.col("all").alias("mg_dm")),
                     F.when(F.col("n") > 0, F.struct(F.lit("Tiny prey").alias("group"),
                                                     F.col("tiny").alias("mg_dm"))))
    e = sums.select("id", "species", "date2", F.explode(groups).alias("__g"))
    return rounded(e.where(F.col("__g").isNotNull()).select(
        "id", "species", "date2", F.col("__g.mg_dm").alias("mg_dm"), F.col("__g.group").alias("group")))


# ---- events family (C, V) ---------------------------------------------------

# Dodge per type (days), recodes, cut-offs and the two survey dates.
# impute_zero_mean also moves the 2024-01-12 sampling day onto 2024-01-13.
DODGE = {"click": 0.5, "view": 0.25, "purchase": 0.0, "signup": -0.25}
COMMUNITY_RENAME = {"view": "viewer", "signup": "signer"}
SURVEY_DATES = ["2024-01-29", "2024-01-30"]
HURDLE_CUT = 5.0


def events(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "events")


@query("parse_dates", """
WITH o AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderstatus FROM orders
),
t AS (
  SELECT o_orderkey, d, o_orderstatus, strftime(d, '%-m/%-d/%Y') AS us_text,
         strftime(d, '%m/%d/%y') AS short_text, strftime(d, '%-d-%b-%y') AS mon_text,
         strftime(d, '%Y-%m-%d') AS iso_text
  FROM o
)
SELECT o_orderkey, us_text, short_text, mon_text,
       CAST(try_strptime(us_text, '%m/%d/%Y') AS DATE) AS parsed_us,
       CAST(try_strptime(short_text, '%m/%d/%y') AS DATE) AS parsed_short,
       CAST(try_strptime(mon_text, '%d-%b-%y') AS DATE) AS parsed_mon,
       CAST(try_strptime(iso_text, '%Y-%m-%d') AS DATE) AS parsed_any,
       CAST(NULL AS DATE) AS parsed_bad
FROM t
""")
def q_parse_dates(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.functions.dates import parse_date_any, parse_dmy_mon, parse_mdy

    o = read_table(spark, base, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("d"), "o_orderstatus")
    t = o.select("o_orderkey", "o_orderstatus",
                 F.date_format("d", "M/d/yyyy").alias("us_text"),
                 F.date_format("d", "MM/dd/yy").alias("short_text"),
                 F.date_format("d", "d-MMM-yy").alias("mon_text"),
                 F.date_format("d", "yyyy-MM-dd").alias("iso_text"))
    return t.select("o_orderkey", "us_text", "short_text", "mon_text",
                    parse_mdy("us_text").alias("parsed_us"),
                    parse_mdy("short_text").alias("parsed_short"),
                    parse_dmy_mon("mon_text").alias("parsed_mon"),
                    parse_date_any("iso_text").alias("parsed_any"),
                    parse_mdy("o_orderstatus").alias("parsed_bad"))


@query("dodge_dates", """
SELECT event_id, event_type, CAST(ts AS DATE) AS date,
       CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_seconds(CAST(round(
         CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.25 WHEN 'purchase' THEN 0.0
                         WHEN 'signup' THEN -0.25 ELSE 0.0 END * 86400) AS BIGINT)) AS date_dodged
FROM events
""")
def q_dodge_dates(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.functions.conditionals import case_when
    from fieldspark.functions.dates import add_fractional_days

    ev = events(spark, base)
    dodge = case_when([(F.col("event_type") == F.lit(k), F.lit(v)) for k, v in DODGE.items()],
                      F.lit(0.0))
    return ev.select("event_id", "event_type", F.to_date("ts").alias("date"),
                     add_fractional_days(F.to_date("ts"), dodge).alias("date_dodged"))


@query("clean_names", """
SELECT c_custkey AS c_cust_key, c_name AS c_name, c_nationkey AS c_nation_key,
       c_acctbal AS c_acct_bal, c_mktsegment AS c_mkt_segment
FROM customer
""")
def q_clean_names(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.sources.readers import clean_names

    c = read_table(spark, base, "customer")
    messy = c.select(F.col("c_custkey").alias("C CustKey"), F.col("c_name").alias("c.Name"),
                     F.col("c_nationkey").alias("C__NationKey "),
                     F.col("c_acctbal").alias("cAcctBal"),
                     F.col("c_mktsegment").alias("C-MKTSegment"))
    return clean_names(messy)


@query("filter_predicates", """
WITH e AS (SELECT event_id, nullif(event_type, 'error') AS et, value FROM events)
SELECT event_id, et, value FROM e
WHERE (et <> 'view' AND value > 10) OR (et = 'click' AND value <= 1)
""")
def q_filter_predicates(spark: SparkSession, base: str) -> DataFrame:
    e = events(spark, base).select("event_id", F.nullif(F.col("event_type"), F.lit("error"))
                                   .alias("et"), "value")
    return e.where(((F.col("et") != "view") & (F.col("value") > 10))
                   | ((F.col("et") == "click") & (F.col("value") <= 1)))


@query("recode_treatment", """
WITH e AS (
  SELECT event_id, CAST(ts AS DATE) AS date, user_id, value,
         CASE WHEN event_type IN ('click', 'view') THEN 'fish' ELSE 'no fish' END AS treatment
  FROM events WHERE event_type <> 'error'
)
SELECT event_id, date, user_id, CASE WHEN treatment = 'fish' THEN 'ctrl' ELSE 'exc' END AS trt,
       value, round(value + 0.01, 6) AS value01
FROM e
""")
def q_recode_treatment(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.plans.spiders import recode_treatment

    ev = events(spark, base).select(
        "event_id", F.to_date("ts").alias("date"), "user_id", F.col("value").alias("spid"),
        F.when(F.col("event_type").isin("click", "view"), F.lit("fish"))
        .otherwise(F.lit("no fish")).alias("treatment"), F.col("event_type").alias("trt"))
    out = recode_treatment(ev, drop_trt="error", count_col="spid")
    return rounded(out.select("event_id", "date", "user_id", "trt",
                              F.col("spid").alias("value"), F.col("spid01").alias("value01")))


@query("drop_na", """
WITH e AS (
  SELECT event_id, nullif(event_type, 'signup') AS et, nullif(props, '{"k": 1}') AS pr, value
  FROM events
)
SELECT * FROM e WHERE et IS NOT NULL AND pr IS NOT NULL
""")
def q_drop_na(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.project import drop_na

    e = events(spark, base).select(
        "event_id", F.nullif(F.col("event_type"), F.lit("signup")).alias("et"),
        F.nullif(F.col("props"), F.lit('{"k": 1}')).alias("pr"), "value")
    return drop_na(e)


@query("strict_sum", """
WITH e AS (SELECT user_id, event_type, CASE WHEN value > 450 THEN NULL ELSE value END AS v FROM events)
SELECT user_id, event_type, count(*) AS n, count(v) AS n_obs,
       round(CASE WHEN count(*) = count(v) THEN sum(v) END, 6) AS strict_total,
       round(CASE WHEN count(*) = count(v) THEN avg(v) END, 6) AS strict_mean,
       round(sum(v), 6) AS total_narm
FROM e GROUP BY user_id, event_type
""")
def q_strict_sum(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.aggregate import strict_mean, strict_sum

    e = events(spark, base).select("user_id", "event_type",
                                   F.when(F.col("value") <= 450, F.col("value")).alias("v"))
    out = e.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_obs"),
        strict_sum("v").alias("strict_total"), strict_mean("v").alias("strict_mean"),
        F.sum("v").alias("total_narm"))
    return rounded(out)


@query("locf_fill", """
WITH e AS (
  SELECT event_id, user_id, ts,
         nullif(trim(CASE WHEN value < 50 THEN '' ELSE event_type END), '') AS prior
  FROM events
)
SELECT event_id, user_id, prior AS prior_raw,
       last_value(prior IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prior
FROM e
""")
def q_locf_fill(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.functions.strings import blank_to_null
    from fieldspark.operators.window import locf

    e = events(spark, base).select(
        "event_id", "user_id", "ts",
        blank_to_null(F.when(F.col("value") < 50, F.lit("")).otherwise(F.col("event_type")))
        .alias("prior"))
    e = e.withColumn("prior_raw", F.col("prior"))
    filled = locf(e, ["user_id"], ["ts", "event_id"], ["prior"], chunk=F.to_date("ts"))
    return filled.select("event_id", "user_id", "prior_raw", "prior")


@query("first_per_key", """
SELECT user_id, event_id, ts, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
""")
def q_first_per_key(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.window import first_per_key

    ev = events(spark, base)
    return first_per_key(ev, ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "ts", "event_type", "value", "props")


@query("impute_zero_mean", """
WITH o AS (SELECT CASE WHEN CAST(ts AS DATE) = DATE '2024-01-12' THEN DATE '2024-01-13'
                       ELSE CAST(ts AS DATE) END AS date2, event_type AS species,
                  CASE WHEN value >= 400 THEN 1 ELSE 0 END AS abund FROM events),
grid AS (SELECT * FROM (SELECT DISTINCT date2 FROM o) CROSS JOIN (SELECT DISTINCT species FROM o)),
raw AS (SELECT date2, species, sum(abund) AS s FROM o GROUP BY date2, species),
f AS (SELECT g.date2, g.species, CAST(coalesce(r.s, 0) AS BIGINT) AS total_abund_raw
      FROM grid g LEFT JOIN raw r USING (date2, species)),
a AS (SELECT *, avg(total_abund_raw) OVER (PARTITION BY species) AS average FROM f)
SELECT date2,
       CASE species WHEN 'view' THEN 'viewer' WHEN 'signup' THEN 'signer' ELSE species END AS species,
       total_abund_raw, round(average, 6) AS average,
       round(CASE WHEN total_abund_raw = 0 THEN average ELSE total_abund_raw END, 6) AS total_abund
FROM a WHERE date2 <> DATE '2024-01-01'
""")
def q_impute_zero_mean(spark: SparkSession, base: str) -> DataFrame:
    import datetime

    from fieldspark.plans.community import community_totals

    o = events(spark, base).select(F.to_date("ts").alias("date"), F.col("event_type")
                                   .alias("species"),
                                   F.when(F.col("value") >= 400, 1).otherwise(0).alias("abund"))
    out = community_totals(o, snap={datetime.date(2024, 1, 12): datetime.date(2024, 1, 13)},
                           drop_date=datetime.date(2024, 1, 1), rename=COMMUNITY_RENAME,
                           complete=True)
    return rounded(out.select("date2", "species", F.col("total_abund_raw").cast("bigint"),
                              "average", "total_abund"))


@query("nearest_survey_join", """
WITH l AS (SELECT event_id, user_id, CAST(ts AS DATE) AS date, value FROM events
           WHERE event_type <> 'view'),
r AS (SELECT user_id, CAST(ts AS DATE) AS date, sum(value) AS value, count(*) AS n FROM events
      WHERE CAST(ts AS DATE) = DATE '2024-01-29' OR CAST(ts AS DATE) = DATE '2024-01-30'
      GROUP BY user_id, CAST(ts AS DATE))
SELECT l.event_id, l.user_id, l.date AS date_x, round(l.value, 6) AS value_x,
       r.date AS date_y, round(r.value, 6) AS value_y, r.n
FROM l LEFT JOIN r ON l.user_id = r.user_id
""")
def q_nearest_survey_join(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.joins import left_join_suffixed

    ev = events(spark, base).withColumn("date", F.to_date("ts"))
    left = ev.where(F.col("event_type") != "view").select("event_id", "user_id", "date", "value")
    d1, d2 = [F.lit(x).cast("date") for x in SURVEY_DATES]
    right = (ev.where((F.col("date") == d1) | (F.col("date") == d2))
             .groupBy("user_id", "date").agg(F.sum("value").alias("value"),
                                             F.count(F.lit(1)).alias("n")))
    out = left_join_suffixed(left, right, ["user_id"], max_multiplicity=len(SURVEY_DATES))
    return rounded(out.select("event_id", "user_id", "date_x", "value_x", "date_y", "value_y", "n"))


@query("poisson_cells", """
WITH o AS (SELECT CAST(ts AS DATE) AS day, event_type FROM events),
grid AS (SELECT * FROM (SELECT DISTINCT day FROM o) CROSS JOIN (SELECT DISTINCT event_type FROM o)),
c AS (SELECT day, event_type, count(*) AS cnt FROM o GROUP BY day, event_type),
f AS (SELECT g.day, g.event_type, coalesce(c.cnt, 0) AS cnt, dayname(g.day) AS weekday
      FROM grid g LEFT JOIN c USING (day, event_type))
SELECT event_type, weekday, count(*) AS n, round(avg(cnt), 6) AS mean, round(ln(avg(cnt)), 6) AS b,
       round(1 / sqrt(count(*) * avg(cnt)), 6) AS se
FROM f GROUP BY event_type, weekday
""")
def q_poisson_cells(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.joins import complete_grid
    from fieldspark.operators.models import cell_means

    o = events(spark, base).select(F.to_date("ts").alias("day"), "event_type")
    counts = o.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("cnt"))
    full = complete_grid(counts, ["day", "event_type"]).join(counts, ["day", "event_type"], "left") \
        .withColumn("cnt", F.coalesce(F.col("cnt"), F.lit(0)).cast("double")) \
        .withColumn("weekday", F.date_format("day", "EEEE"))
    fit = cell_means(full, ["event_type", "weekday"], "cnt", family="poisson")
    return rounded(fit.select("event_type", "weekday", "n", "mean", "b", "se"))


@query("hurdle_means", """
WITH e AS (SELECT event_type AS species, CAST(date_trunc('week', ts) AS DATE) AS date2,
                  CASE WHEN value < 5 THEN 0 ELSE value END AS y FROM events),
mu AS (SELECT species, date2, avg(CASE WHEN y > 0 THEN y END) AS mu, count(CASE WHEN y > 0 THEN 1 END) AS n_pos
       FROM e GROUP BY species, date2),
hu AS (SELECT species, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) AS hu, count(*) AS n_hu FROM e GROUP BY species)
SELECT species, date2, round(mu, 6) AS mu, n_pos, round(hu, 6) AS hu, n_hu,
       round(mu * (1 - hu), 6) AS epred
FROM mu LEFT JOIN hu USING (species)
""")
def q_hurdle_means(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.models import hurdle_means

    e = events(spark, base).select(
        F.col("event_type").alias("species"), F.date_trunc("week", "ts").cast("date").alias("date2"),
        F.when(F.col("value") < HURDLE_CUT, F.lit(0.0)).otherwise(F.col("value")).alias("y"))
    out = hurdle_means(e, "y", ["species", "date2"], ["species"])
    return rounded(out.select("species", "date2", "mu", "n_pos", "hu", "n_hu", "epred"))


@query("shrunken_means", """
WITH e AS (SELECT user_id, ln(value) AS v FROM events WHERE value > 0),
g AS (SELECT user_id, count(*) AS n, avg(v) AS ybar, var_pop(v) * count(*) AS ss
      FROM e GROUP BY user_id),
s AS (SELECT sum(ss) / (sum(n) - count(*)) AS s2, var_samp(ybar) AS vb, avg(1.0 / n) AS inv_n,
             avg(ybar) AS m FROM g),
t AS (SELECT *, greatest(vb - s2 * inv_n, 0.0) AS t2 FROM s)
SELECT g.user_id, g.n, round(g.ybar, 6) AS ybar,
       round(CASE WHEN t.t2 > 0 THEN t.t2 / (t.t2 + t.s2 / g.n) ELSE 0.0 END, 6) AS w,
       round(t.m + CASE WHEN t.t2 > 0 THEN t.t2 / (t.t2 + t.s2 / g.n) ELSE 0.0 END * (g.ybar - t.m), 6)
         AS shrunk,
       round(exp(t.m + CASE WHEN t.t2 > 0 THEN t.t2 / (t.t2 + t.s2 / g.n) ELSE 0.0 END * (g.ybar - t.m)), 6)
         AS shrunk_exp
FROM g CROSS JOIN t
""")
def q_shrunken_means(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.models import shrunken_means

    out = shrunken_means(events(spark, base).where(F.col("value") > 0), "user_id", "value")
    return rounded(out.select("user_id", "n", "ybar", "w", "shrunk", "shrunk_exp"))


@query("distribution_bins", """
WITH e AS (SELECT event_type, value, log10(value) AS x FROM events WHERE value > 0),
b AS (SELECT event_type, CAST(least(greatest(floor((x - (-2.0)) / 0.25), 0), 19) AS INTEGER) AS bin,
             count(*) AS n FROM e GROUP BY ALL),
q AS (SELECT event_type, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50,
             quantile_cont(value, 0.75) AS q75 FROM e GROUP BY event_type)
SELECT b.event_type, b.bin, b.n, round(CAST(-2.0 + b.bin * 0.25 AS DOUBLE), 6) AS bin_lo,
       round(q.q25, 6) AS q25, round(q.q50, 6) AS q50, round(q.q75, 6) AS q75
FROM b LEFT JOIN q USING (event_type)
""")
def q_distribution_bins(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.aggregate import distribution_bins

    out = distribution_bins(events(spark, base), ["event_type"], "value", -2.0, 3.0, 20)
    return rounded(out.select("event_type", "bin", "n", "bin_lo", "q25", "q50", "q75"))


@query("group_means_model", """
WITH e AS (SELECT regexp_replace(event_type, 'signup', 'sign_up') AS taxon, value FROM events
           WHERE value > 0)
SELECT taxon, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
       round(ln(avg(value)), 6) AS b, round(stddev_samp(value) / (avg(value) * sqrt(count(value))), 6) AS se
FROM e GROUP BY taxon
""")
def q_group_means_model(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.functions.strings import replace_first
    from fieldspark.operators.models import cell_means

    e = events(spark, base).where(F.col("value") > 0).select(
        replace_first("event_type", "signup", "sign_up").alias("taxon"), "value")
    return rounded(cell_means(e, ["taxon"], "value").select("taxon", "n", "mean", "sd", "b", "se"))


# ---- wide counts (E), draws (X) and models ---------------------------------

def events_draw_epred(spark: SparkSession, base: str, carry_abundance: bool = False) -> DataFrame:
    """Expected value per (draw-model cell, draw)."""
    from fieldspark.operators.draws import epred_cell_means

    return epred_cell_means(draws_table(spark, base), draw_grid(spark, base),
                            ["species", "date2", "prey_stage"],
                            carry=["total_abund"] if carry_abundance else [],
                            grid_is_distinct=True)


EPRED_SQL = """
ev AS (
  SELECT event_type AS species, CAST(date_trunc('week', ts) AS DATE) AS date2,
         CASE WHEN value >= 50 THEN 'pa' ELSE 'not_pa' END AS prey_stage
  FROM events
),
cells AS (
  SELECT species, date2, prey_stage,
         row_number() OVER (ORDER BY species, date2, prey_stage) - 1 AS cell_index
  FROM (SELECT DISTINCT species, date2, prey_stage FROM ev)
),
ab AS (SELECT date2, species, CAST(count(*) AS DOUBLE) AS total_abund FROM ev GROUP BY date2, species),
ep AS (
  SELECT c.species, c.date2, c.prey_stage, e.vec_id AS draw,
         exp(CAST(e.embedding[c.cell_index + 1] AS DOUBLE)) AS epred
  FROM cells c CROSS JOIN embeddings e
)"""


@query("fill_zero_biomass", """
WITH r AS (
  SELECT l_orderkey AS o_orderkey, sum(l_quantity) AS chir, sum(l_tax) AS tax, sum(l_discount) AS disc
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey
)
SELECT o.o_orderkey, round(coalesce(r.chir, 0), 6) AS chir, round(coalesce(r.tax, 0), 6) AS tax,
       round(coalesce(r.disc, 0), 6) AS disc
FROM orders o LEFT JOIN r USING (o_orderkey)
""")
def q_fill_zero_biomass(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.project import fill_zero

    li = read_table(spark, base, "lineitem").where(F.col("l_returnflag") == "R")
    r = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("chir"), F.sum("l_tax").alias("tax"),
        F.sum("l_discount").alias("disc"))
    o = read_table(spark, base, "orders").select("o_orderkey")
    return rounded(fill_zero(o.join(r, ["o_orderkey"], "left")))


E_SQL = """
e AS (
  SELECT l_orderkey AS stat, l_returnflag AS loc, CAST(l_quantity AS DOUBLE) AS chir,
         CAST(round(l_tax * 100) AS INTEGER) AS doli, CAST(round(l_discount * 100) AS INTEGER) AS tric,
         l_linenumber AS odo, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_linenumber END AS ephe,
         0.36 AS area, CASE WHEN l_linestatus = 'O' THEN 4 ELSE 3 END AS days
  FROM lineitem
)"""


@query("biomass_convert", "WITH " + E_SQL + """,
m AS (
  SELECT stat, loc, coalesce(chir, 0) * 0.99 AS chiro_mg_dm,
         CAST(coalesce(doli, 0) AS DOUBLE) * 0.65 AS doli_mg_dm,
         CAST(coalesce(tric, 0) AS DOUBLE) * 0.8 AS tric_mg_dm,
         CAST(coalesce(odo, 0) AS DOUBLE) * 6.2 AS odo_mg_dm,
         CAST(coalesce(ephe, 0) AS DOUBLE) * 1.1 AS ephem_mg_dm, area, days
  FROM e
)
SELECT stat, loc, round(chiro_mg_dm, 6) AS chiro_mg_dm, round(doli_mg_dm, 6) AS doli_mg_dm,
       round(tric_mg_dm, 6) AS tric_mg_dm, round(odo_mg_dm, 6) AS odo_mg_dm,
       round(ephem_mg_dm, 6) AS ephem_mg_dm,
       round(chiro_mg_dm + doli_mg_dm + tric_mg_dm + odo_mg_dm + ephem_mg_dm, 6) AS tot_mg_dm,
       round((chiro_mg_dm + doli_mg_dm + tric_mg_dm + odo_mg_dm + ephem_mg_dm) / area / days, 6)
         AS tot_mg_dm_m2_d,
       CAST(stat AS VARCHAR) || '_' || loc AS id
FROM m
""")
def q_biomass_convert(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.plans.biomass import emergence_biomass

    li = read_table(spark, base, "lineitem")
    e = li.select(F.col("l_orderkey").alias("stat"), F.col("l_returnflag").alias("loc"),
                  F.col("l_quantity").alias("chir"),
                  F.round(F.col("l_tax") * 100).cast("int").alias("doli"),
                  F.round(F.col("l_discount") * 100).cast("int").alias("tric"),
                  F.col("l_linenumber").alias("odo"),
                  F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")).alias("ephe"),
                  F.lit(0.36).alias("area"),
                  F.when(F.col("l_linestatus") == "O", 4).otherwise(3).alias("days"))
    out = emergence_biomass(e)
    return rounded(out.select("stat", "loc", "chiro_mg_dm", "doli_mg_dm", "tric_mg_dm",
                              "odo_mg_dm", "ephem_mg_dm", "tot_mg_dm", "tot_mg_dm_m2_d", "id"))


@query("length_mass", """
WITH m AS (SELECT 0.1 * pow(l_quantity, 1.57) AS mg_dm FROM lineitem)
SELECT count(mg_dm) AS n, round(avg(mg_dm), 6) AS mean, round(stddev_samp(mg_dm), 6) AS sd,
       round(ln(avg(mg_dm)), 6) AS b, round(stddev_samp(mg_dm) / (avg(mg_dm) * sqrt(count(mg_dm))), 6) AS se
FROM m
""")
def q_length_mass(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.functions.mathx import power_law
    from fieldspark.operators.models import cell_means

    li = read_table(spark, base, "lineitem").select(
        F.lit(0.1).alias("a"), F.lit(1.57).alias("b"), "l_quantity")
    mg = li.withColumn("mg_dm", power_law("l_quantity", F.col("a"), F.col("b")))
    return rounded(cell_means(mg, [], "mg_dm").select("n", "mean", "sd", "b", "se"))


@query("backtransform_mean", """
WITH u AS (
  SELECT unnest(embedding) AS coef, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings
)
SELECT lower(regexp_replace('b_Term' || CAST(pos AS VARCHAR), 'b_', '')) AS taxon,
       round(avg(exp(CAST(coef AS DOUBLE))), 6) AS mean_mgdm
FROM u GROUP BY pos
""")
def q_backtransform_mean(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.functions.strings import remove_first

    emb = read_table(spark, base, "embeddings").select(F.posexplode("embedding").alias("pos", "coef"))
    long = emb.select(F.concat(F.lit("b_Term"), F.col("pos").cast("string")).alias("key"),
                      F.col("coef").cast("double").alias("value"))
    out = long.groupBy("key").agg(F.avg(F.exp("value")).alias("mean_mgdm"))
    return rounded(out.select(F.lower(remove_first("key", "b_")).alias("taxon"), "mean_mgdm"))


@query("biomass_unpivot", """
WITH w AS (
  SELECT l_orderkey AS id, l_linenumber AS stat, l_returnflag AS location, l_quantity, l_discount, l_tax
  FROM lineitem
),
long AS (
  SELECT id, stat, location, 'l_quantity' AS taxon, l_quantity AS abundance FROM w
  UNION ALL SELECT id, stat, location, 'l_discount', l_discount FROM w
  UNION ALL SELECT id, stat, location, 'l_tax', l_tax FROM w
),
mass AS (
  SELECT CASE p_type WHEN 'STANDARD' THEN 'l_quantity' WHEN 'SMALL' THEN 'l_discount'
                     WHEN 'LARGE' THEN 'l_tax' ELSE lower(p_type) END AS taxon,
         avg(p_retailprice) / 1000 AS mean_mgdm
  FROM part WHERE p_retailprice > 0 GROUP BY p_type
)
SELECT taxon, id, stat, location, round(abundance, 6) AS abundance, round(mean_mgdm, 6) AS mean_mgdm,
       round(CAST(0.76 * 0.3 AS DOUBLE), 6) AS sample_m2,
       round(abundance * mean_mgdm / (0.76 * 0.3), 6) AS benthic_mg_dm_m2,
       round(0.01 + abundance * mean_mgdm / (0.76 * 0.3), 6) AS benthic_mg01,
       round(abundance * mean_mgdm / (0.76 * 0.3) / 1000 + 0.001, 6) AS benthic_g01
FROM long JOIN mass USING (taxon)
""")
def q_biomass_unpivot(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.functions.strings import replace_first
    from fieldspark.plans.biomass import benthic_biomass

    li = read_table(spark, base, "lineitem")
    wide = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("stat"),
                     F.col("l_returnflag").alias("location"), "l_quantity", "l_discount", "l_tax")
    part = read_table(spark, base, "part").where(F.col("p_retailprice") > 0)
    taxon = F.lower(F.col("p_type"))
    for pat, rep in [("standard", "l_quantity"), ("small", "l_discount"), ("large", "l_tax")]:
        taxon = replace_first(taxon, f"^{pat}$", rep)
    mass = part.groupBy(taxon.alias("taxon")).agg(
        (F.avg("p_retailprice") / F.lit(1000.0)).alias("mean_mgdm"))
    return rounded(benthic_biomass(wide, mass, "l_quantity", "l_tax"))


@query("unpivot_all", """
SELECT 's_suppkey' AS key, CAST(s_suppkey AS DOUBLE) AS value FROM supplier
UNION ALL SELECT 's_nationkey', CAST(s_nationkey AS DOUBLE) FROM supplier
UNION ALL SELECT 's_acctbal', round(s_acctbal, 6) FROM supplier
""")
def q_unpivot_all(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.project import select_prefix
    from fieldspark.operators.reshape import unpivot_all

    s = select_prefix(read_table(spark, base, "supplier"), "s_", numeric_only=True)
    return rounded(unpivot_all(s, "key", "value"))


@query("add_row", """
SELECT r_regionkey, r_name FROM region
UNION ALL SELECT CAST(5 AS INTEGER), 'ANTARCTICA'
""")
def q_add_row(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.sources.readers import add_row

    return add_row(read_table(spark, base, "region"), r_regionkey=5, r_name="ANTARCTICA")


@query("complete_grid", """
SELECT f.l_returnflag, s.l_linestatus, y.ship_year
FROM (SELECT DISTINCT l_returnflag FROM lineitem) f
CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) s
CROSS JOIN (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS ship_year FROM lineitem) y
""")
def q_complete_grid(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.joins import complete_grid

    li = read_table(spark, base, "lineitem").select(
        "l_returnflag", "l_linestatus", F.year("l_shipdate").alias("ship_year"))
    return complete_grid(li, ["l_returnflag", "l_linestatus", "ship_year"])


@query("epred_draws", """
WITH g AS (
  SELECT * FROM (SELECT DISTINCT l_returnflag FROM lineitem)
  CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem)
)
SELECT g.l_returnflag, g.l_linestatus, e.vec_id AS draw,
       round(exp(CAST(e.embedding[1] AS DOUBLE)
         + CAST(e.embedding[2] AS DOUBLE) * CAST(g.l_returnflag = 'N' AS DOUBLE)
         + CAST(e.embedding[3] AS DOUBLE) * CAST(g.l_returnflag = 'R' AS DOUBLE)
         + CAST(e.embedding[4] AS DOUBLE) * CAST(g.l_linestatus = 'O' AS DOUBLE)
         + CAST(e.embedding[5] AS DOUBLE) * CAST(g.l_returnflag = 'N' AND g.l_linestatus = 'O' AS DOUBLE)
         + CAST(e.embedding[6] AS DOUBLE) * CAST(g.l_returnflag = 'R' AND g.l_linestatus = 'O' AS DOUBLE)
       ), 6) AS epred
FROM g CROSS JOIN embeddings e
""")
def q_epred_draws(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.draws import epred_draws, factor_levels_all, treatment_design
    from fieldspark.operators.joins import complete_grid

    li = read_table(spark, base, "lineitem").select("l_returnflag", "l_linestatus")
    factors = factor_levels_all(li, ["l_returnflag", "l_linestatus"])
    grid = complete_grid(li, list(factors))
    design, terms = treatment_design(grid, factors)
    return rounded(epred_draws(draws_table(spark, base), design, list(factors)))


@query("scale_by_abundance", "WITH " + EPRED_SQL + """
SELECT ep.species, ep.date2, ep.prey_stage, ep.draw, round(ep.epred, 6) AS epred,
       ab.total_abund, round(ep.epred * ab.total_abund, 6) AS population_epred
FROM ep LEFT JOIN ab ON ep.date2 = ab.date2 AND ep.species = ab.species
""")
def q_scale_by_abundance(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.draws import scale_by_abundance

    ep = events_draw_epred(spark, base)
    ab = draw_cells(spark, base).groupBy("date2", "species").agg(
        F.count(F.lit(1)).cast("double").alias("total_abund"))
    out = scale_by_abundance(ep, ab, by=["date2", "species"])
    return rounded(out.select("species", "date2", "prey_stage", "draw", "epred", "total_abund",
                              "population_epred"))


# Plot order of species, dodge (days) and panel titles.
PLOT_SPECIES_FIRST = ["Community", "Click", "View"]
PLOT_DODGE = {"Click": 0.5, "View": 0.25, "Community": 0.0, "Purchase": -0.25}
PLOT_PANELS = {"community": "d) Per Community", "population": "e) Per Population",
               "capita": "f) Per capita"}


@query("thin_draws", "WITH " + POSTS_SQL + """,
t AS (SELECT * FROM posts WHERE draw <= 300),
lvl AS (
  SELECT species, CASE WHEN species = 'Community' THEN 1 WHEN species = 'Click' THEN 2
                       WHEN species = 'View' THEN 3
                       ELSE 3 + row_number() OVER (PARTITION BY species IN ('Community', 'Click', 'View')
                                                   ORDER BY species) END AS species_level
  FROM (SELECT DISTINCT species FROM t)
)
SELECT t.data_level, t.species, t.date2, t.draw, round(t.prop_pa, 6) AS prop_pa,
       round(t.total, 6) AS total, CAST(lvl.species_level AS INTEGER) AS species_level,
       CAST(t.date2 AS TIMESTAMP) + to_seconds(CAST(round(
         CASE t.species WHEN 'Click' THEN 0.5 WHEN 'View' THEN 0.25 WHEN 'Community' THEN 0.0
                        WHEN 'Purchase' THEN -0.25 ELSE 0.0 END * 86400) AS BIGINT)) AS date_dodged,
       CASE WHEN t.data_level LIKE '%community%' THEN 'd) Per Community'
            WHEN t.data_level LIKE '%population%' THEN 'e) Per Population'
            ELSE 'f) Per capita' END AS panel
FROM t JOIN lvl USING (species)
""")
def q_thin_draws(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.functions.conditionals import case_when
    from fieldspark.plans.summaries import plot_ready_draws

    named = case_when([(F.col("species") == F.lit(k), F.lit(v)) for k, v in SPECIES_NAMES.items()],
                      F.col("species"))
    species = draw_grid(spark, base).select(named.alias("species"))
    out = plot_ready_draws(diet_posts(spark, base), 300, PLOT_SPECIES_FIRST, PLOT_DODGE, PLOT_PANELS,
                           species)
    return rounded(out.select("data_level", "species", "date2", "draw", "prop_pa", "total",
                              "species_level", "date_dodged", "panel"))


@query("community_rollup", "WITH " + POSTS_SQL + """
SELECT date2, draw, round(pa, 6) AS pa, round(not_pa, 6) AS not_pa, round(total, 6) AS total,
       round(prop_pa, 6) AS prop_pa
FROM posts WHERE data_level = 'Per community'
""")
def q_community_rollup(spark: SparkSession, base: str) -> DataFrame:
    p = diet_posts(spark, base).where(F.col("data_level") == "Per community")
    return rounded(p.select("date2", "draw", "pa", "not_pa", "total", "prop_pa"))


@query("species_average", "WITH " + POSTS_SQL + """,
lng AS (
  SELECT data_level, species, date2, draw, 'prop_pa' AS name, prop_pa AS value FROM posts
  UNION ALL
  SELECT data_level, species, date2, draw, 'total', total FROM posts
)
SELECT data_level, 'All Species' AS species, draw, name, round(avg(value), 6) AS value
FROM lng GROUP BY data_level, draw, name
UNION ALL
SELECT data_level, species, draw, name, round(avg(value), 6) FROM lng
GROUP BY data_level, species, draw, name
""")
def q_species_average(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.draws import species_average, to_long

    long = to_long(diet_posts(spark, base), ["data_level", "species", "date2", "draw"],
                   ["prop_pa", "total"])
    out = species_average(long, "data_level", "draw", "species")
    return rounded(out.select("data_level", "species", "draw", "name", "value"))


@query("point_interval", "WITH " + EPRED_SQL + """
SELECT species, date2, prey_stage,
       round(quantile_cont(epred, 0.025), 6) AS q025, round(quantile_cont(epred, 0.17), 6) AS q170,
       round(quantile_cont(epred, 0.5), 6) AS q500, round(quantile_cont(epred, 0.83), 6) AS q830,
       round(quantile_cont(epred, 0.975), 6) AS q975
FROM ep GROUP BY species, date2, prey_stage
""")
def q_point_interval(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.draws import point_interval

    ep = events_draw_epred(spark, base)
    return rounded(point_interval(ep, ["species", "date2", "prey_stage"], "epred"))


@query("cumulative_draws", "WITH " + POSTS_SQL + """,
c AS (SELECT data_level, species, draw, sum(total) AS cum FROM posts GROUP BY data_level, species, draw),
s AS (
  SELECT data_level, species,
         CAST(CAST(round(avg(cum)) AS BIGINT) AS VARCHAR) || ' (' ||
         CAST(CAST(round(stddev_samp(cum)) AS BIGINT) AS VARCHAR) || ')' AS cell
  FROM c GROUP BY data_level, species
)
SELECT species,
       max(CASE WHEN data_level = 'Per capita' THEN cell END) AS per_capita,
       max(CASE WHEN data_level = 'Per population' THEN cell END) AS per_population,
       max(CASE WHEN data_level = 'Per community' THEN cell END) AS per_community
FROM s GROUP BY species
""")
def q_cumulative_draws(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.draws import cumulative_draws
    from fieldspark.operators.reshape import pivot_wider

    cum = cumulative_draws(diet_posts(spark, base), ["data_level", "species"], "draw", "total")
    wide = pivot_wider(cum, ["species"], "data_level", "cell",
                       ["Per capita", "Per population", "Per community"])
    return wide.select("species", F.col("Per capita").alias("per_capita"),
                       F.col("Per population").alias("per_population"),
                       F.col("Per community").alias("per_community"))


@query("cell_means_model", """
SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean,
       round(stddev_samp(l_extendedprice), 6) AS sd, round(ln(avg(l_extendedprice)), 6) AS b,
       round(stddev_samp(l_extendedprice) / (avg(l_extendedprice) * sqrt(count(l_extendedprice))), 6) AS se
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def q_cell_means_model(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.models import cell_means

    li = read_table(spark, base, "lineitem")
    return rounded(cell_means(li, ["l_returnflag", "l_linestatus"], "l_extendedprice")
                   .select("l_returnflag", "l_linestatus", "n", "mean", "sd", "b", "se"))


def sql_digest(salt: str, *keys: str) -> str:
    """MD5 text of ``functions.random.row_digest`` in DuckDB SQL."""
    return f"md5('{SEED}|' || {salt} || '|' || " + " || '|' || ".join(
        f"CAST({k} AS VARCHAR)" for k in keys) + ")"


def sql_unit(digest: str, start: int, digits: int) -> str:
    return f"((('0x' || substr({digest}, {start}, {digits}))::BIGINT + 0.5) / {float(16**digits)!r})"


def sql_normal(digest: str, digits: int = 13) -> str:
    u1, u2 = sql_unit(digest, 1, digits), sql_unit(digest, digits + 1, digits)
    return f"(sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2}))"


def sql_gamma(rows: str, keys: list[str], shape: str, scale: str, columns: str) -> str:
    """Accepted Marsaglia-Tsang proposal of each row of ``rows`` (shape >= 1)."""
    return f"""
proposals AS (SELECT *, {shape} - 1 / 3.0 AS d, {sql_digest("k", *keys)} AS h
              FROM {rows} CROSS JOIN range(1, 9) AS r(k)),
steps AS (SELECT *, {sql_normal("h", 10)} AS z, {sql_unit("h", 21, 10)} AS u FROM proposals),
cubes AS (SELECT *, pow(1 + z / sqrt(9 * d), 3) AS v FROM steps),
accepted AS (SELECT * FROM cubes WHERE v > 0 AND ln(u) < 0.5 * z * z + d - d * v + d * ln(
               CASE WHEN v > 0 THEN v ELSE 1 END)
             QUALIFY row_number() OVER (PARTITION BY {", ".join(keys)} ORDER BY k) = 1),
gamma_draws AS (SELECT {columns}, d * v * {scale} AS draw_value FROM accepted)"""


@query("draws_from_fit", f"""
WITH c AS (
  SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, avg(l_extendedprice) AS m,
         stddev_samp(l_extendedprice) AS sd
  FROM lineitem GROUP BY ALL
),
phi AS (SELECT sum((n - 1) * sd * sd / (m * m)) / (sum(n) - count(*)) AS phi FROM c),
dr AS (
  SELECT f, s, draw, ln(m) + sqrt(phi / n) * {sql_normal(sql_digest("0", "f", "s", "draw"))} AS eta
  FROM c CROSS JOIN phi CROSS JOIN range(1, 1001) AS r(draw)
),
lo AS (SELECT min(f) AS f0, min(s) AS s0 FROM c),
w AS (
  SELECT dr.*, f0, s0,
         max(CASE WHEN f = f0 AND s = s0 THEN eta END) OVER (PARTITION BY draw) AS base,
         max(CASE WHEN s = s0 THEN eta END) OVER (PARTITION BY draw, f) AS row_eta,
         max(CASE WHEN f = f0 THEN eta END) OVER (PARTITION BY draw, s) AS col_eta
  FROM dr CROSS JOIN lo
)
SELECT draw,
       CASE WHEN f = f0 AND s = s0 THEN '(Intercept)' WHEN s = s0 THEN 'l_returnflag' || f
            WHEN f = f0 THEN 'l_linestatus' || s
            ELSE 'l_returnflag' || f || ':l_linestatus' || s END AS term,
       round(CASE WHEN f = f0 AND s = s0 THEN eta WHEN s = s0 OR f = f0 THEN eta - base
                  ELSE eta - row_eta - col_eta + base END, 6) AS coef
FROM w
""")
def q_draws_from_fit(spark: SparkSession, base: str) -> DataFrame:
    """Coefficient draws of the flag x status Gamma model (full covariance)."""
    from fieldspark.operators.models import cell_means, pooled_gamma_se, saturated_draws

    li = read_table(spark, base, "lineitem")
    factors = ("l_returnflag", "l_linestatus")
    cells = pooled_gamma_se(cell_means(li, list(factors), "l_extendedprice"))
    return rounded(saturated_draws(cells, factors, 1000, SEED))


@query("predicted_draws", "WITH " + EPRED_SQL + "," + sql_gamma(
    "ep", ["species", "date2", "prey_stage", "draw"], "2.0", "epred / 2.0",
    "species, date2, prey_stage, draw, epred") + """
SELECT species, date2, prey_stage, draw, round(epred, 6) AS epred,
       round(draw_value, 6) AS prediction
FROM gamma_draws
""")
def q_predicted_draws(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.models import predicted_draws

    ep = events_draw_epred(spark, base)
    return rounded(predicted_draws(ep, ["species", "date2", "prey_stage", "draw"], 2.0, SEED))


@query("prior_grid", f"""
WITH ev AS (
  SELECT event_type AS species, CAST(date_trunc('week', ts) AS DATE) AS date2,
         CASE WHEN value >= 50 THEN 'pa' ELSE 'not_pa' END AS prey_stage
  FROM events
),
pri AS (
  SELECT iter, 2.0 * {sql_normal(sql_digest("0", "iter"))} AS "int",
         2.0 * {sql_normal(sql_digest("1", "iter"))} AS b1,
         2.0 * {sql_normal(sql_digest("2", "iter"))} AS int_hu,
         2.0 * {sql_normal(sql_digest("3", "iter"))} AS b1_hu
  FROM range(1, 101) AS r(iter)
),
g AS (
  SELECT * FROM pri CROSS JOIN (SELECT DISTINCT date2, prey_stage FROM ev)
  CROSS JOIN (SELECT DISTINCT species FROM ev)
),
n AS (
  SELECT *, CASE WHEN date2 = (SELECT min(date2) FROM ev) THEN 0 ELSE 1 END AS date_no,
         CASE WHEN prey_stage = 'not_pa' THEN 0 ELSE 1 END AS prey_stage_no,
         {", ".join(f"-ln({sql_unit(sql_digest(str(10 + i), 'iter', 'date2', 'prey_stage', 'species'), 1, 13)}) / 2.0 AS {c}"
                    for i, c in enumerate(("r_int", "r_slopes1", "r_slopes2", "r_slopes3")))}
  FROM g
),
y AS (
  SELECT *, date_no * prey_stage_no AS date_prey_no,
         exp("int" + b1 * date_no + b1 * prey_stage_no + b1 * date_no * prey_stage_no) AS y_sim,
         exp("int" + r_int + (b1 + r_slopes1) * date_no + (b1 + r_slopes2) * prey_stage_no
             + (b1 + r_slopes3) * date_no * prey_stage_no) AS y_species_sim,
         1 / (1 + exp(-(int_hu + b1_hu * (date_no + prey_stage_no + date_no * prey_stage_no)))) AS hu_sim
  FROM n
)
SELECT iter, date2, prey_stage, species, CAST(date_no AS INTEGER) AS date_no,
       CAST(prey_stage_no AS INTEGER) AS prey_stage_no, CAST(date_prey_no AS INTEGER) AS date_prey_no,
       round("int", 6) AS "int", round(b1, 6) AS b1, round(int_hu, 6) AS int_hu,
       round(b1_hu, 6) AS b1_hu, round(r_int, 6) AS r_int, round(r_slopes1, 6) AS r_slopes1,
       round(r_slopes2, 6) AS r_slopes2, round(r_slopes3, 6) AS r_slopes3,
       round(ln(y_sim), 6) AS log_y_sim, round(ln(y_species_sim), 6) AS log_y_species_sim,
       round(hu_sim, 6) AS hu_sim, round(1 - y_hu_sim / y_sim, 6) AS hu_back,
       round(1 - y_hu_sim_species / y_species_sim, 6) AS hu_back_species
FROM (SELECT *, y_sim * (1 - hu_sim) AS y_hu_sim, y_species_sim * (1 - hu_sim) AS y_hu_sim_species
      FROM y)
""")
def q_prior_grid(spark: SparkSession, base: str) -> DataFrame:
    """Prior simulation; the simulated values span many orders of magnitude,
    so they are compared on the log scale and as shares."""
    from fieldspark.operators.models import prior_grid

    cells = draw_cells(spark, base)
    first = cells.agg(F.min("date2")).scalar()
    g = prior_grid(spark, 100, cells.select("date2", "prey_stage"), ["date2", "prey_stage"],
                   cells.select("species"), "species", first, "not_pa", SEED)
    return rounded(g.select(
        "iter", "date2", "prey_stage", "species", "date_no", "prey_stage_no", "date_prey_no", "int",
        "b1", "int_hu", "b1_hu", "r_int", "r_slopes1", "r_slopes2", "r_slopes3",
        F.log("y_sim").alias("log_y_sim"), F.log("y_species_sim").alias("log_y_species_sim"),
        "hu_sim", (1 - F.col("y_hu_sim") / F.col("y_sim")).alias("hu_back"),
        (1 - F.col("y_hu_sim_species") / F.col("y_species_sim")).alias("hu_back_species")))


@query("ppc_bins", """
WITH pos AS (SELECT event_type, value, event_id FROM events WHERE value > 0),
fit AS (SELECT event_type, avg(value) AS m, avg(value) * avg(value) / var_samp(value) AS shape
        FROM pos GROUP BY event_type),
reps AS (SELECT p.*, f.m, f.shape, rep FROM pos p JOIN fit f USING (event_type)
         CROSS JOIN range(1, 21) AS q(rep)),
boosted AS (SELECT event_type, event_id, rep, m, shape,
                   CASE WHEN shape < 1 THEN shape + 1 ELSE shape END AS a FROM reps),
""" + sql_gamma("boosted", ["event_type", "event_id", "rep"], "a",
                f"(m / shape) * CASE WHEN shape < 1 THEN pow({sql_unit(sql_digest('0', 'event_type', 'event_id', 'rep'), 1, 13)}, 1 / shape) ELSE 1 END",
                "event_type") + """,
b AS (
  SELECT event_type, value AS v, 1 AS seen FROM pos
  UNION ALL SELECT event_type, draw_value, 0 FROM gamma_draws
)
SELECT event_type,
       CAST(least(greatest(floor((CASE WHEN v > 0 THEN log10(v) ELSE -2.0 END + 2.0) / 0.25), 0), 19)
            AS INTEGER) AS bin,
       count(CASE WHEN seen = 1 THEN 1 END) AS n_obs,
       round(count(CASE WHEN seen = 0 THEN 1 END) / 20.0, 6) AS n_rep_mean
FROM b GROUP BY ALL
""")
def q_ppc_bins(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.models import ppc_bins

    ev = read_table(spark, base, "events")
    return rounded(ppc_bins(ev, "event_type", "value", "event_id", 20, -2.0, 3.0, 20, SEED))


# ---- comparison rows (D7) and treatment-labelled draws (D10) --------------

# Treatment names given to the return flags.
FLAG_TREATMENT = {"A": "Ambient", "N": "Cage Control", "R": "Exclusion"}


@query("cage_comparison", """
WITH e AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS date,
         CASE l_returnflag WHEN 'A' THEN 'Ambient' WHEN 'N' THEN 'Cage Control'
                           WHEN 'R' THEN 'Exclusion' END AS trt,
         l_quantity AS chir, l_tax * 100 AS doli, l_discount * 100 AS tric
  FROM lineitem
),
f AS (SELECT * FROM e WHERE trt <> 'Exclusion' AND date <> 1995),
long AS (
  SELECT date, trt, 'chir' AS taxon, chir AS abund FROM f
  UNION ALL SELECT date, trt, 'doli', doli FROM f
  UNION ALL SELECT date, trt, 'tric', tric FROM f
),
o AS (
  SELECT taxon, row_number() OVER (ORDER BY avg(abund) DESC NULLS LAST, taxon) AS taxon_order
  FROM long GROUP BY taxon
)
SELECT long.taxon, date, trt, round(abund, 6) AS abund, taxon_order FROM long JOIN o USING (taxon)
""")
def q_cage_comparison(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.functions.conditionals import case_when
    from fieldspark.plans.biomass import cage_comparison

    li = read_table(spark, base, "lineitem")
    trt = case_when([(F.col("l_returnflag") == F.lit(k), F.lit(v)) for k, v in FLAG_TREATMENT.items()])
    e = li.select(F.year("l_shipdate").alias("date"), trt.alias("trt"),
                  F.col("l_quantity").alias("chir"), (F.col("l_tax") * 100).alias("doli"),
                  (F.col("l_discount") * 100).alias("tric"))
    out = cage_comparison(e, ["date", "trt"], exclude_date=1995)
    return rounded(out.select("taxon", "date", "trt", "abund", "taxon_order"))


@query("treatment_draws", """
WITH ev AS (
  SELECT strftime(CAST(date_trunc('week', ts) AS DATE), '%-m/%-d/%Y') AS date,
         CASE WHEN event_type IN ('click', 'view') THEN 'ctrl' ELSE 'exc' END AS trt2
  FROM events
),
g AS (SELECT d.date, t.trt2 FROM (SELECT DISTINCT date FROM ev) d CROSS JOIN (SELECT DISTINCT trt2 FROM ev) t),
c AS (SELECT *, row_number() OVER (ORDER BY date, trt2) - 1 AS cell_index FROM g)
SELECT CAST(strptime(c.date, '%m/%d/%Y') AS DATE) AS date, c.trt2, e.vec_id AS draw,
       round(exp(CAST(e.embedding[c.cell_index + 1] AS DOUBLE)), 6) AS epred,
       CASE WHEN c.trt2 = 'ctrl' THEN 'fish' ELSE 'no fish' END AS trt
FROM c CROSS JOIN embeddings e
""")
def q_treatment_draws(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.functions.dates import parse_mdy
    from fieldspark.operators.draws import epred_cell_means
    from fieldspark.operators.joins import complete_grid
    from fieldspark.plans.spiders import label_treatment

    ev = events(spark, base).select(
        F.date_format(F.date_trunc("week", "ts"), "M/d/yyyy").alias("date"),
        F.when(F.col("event_type").isin("click", "view"), F.lit("ctrl")).otherwise(F.lit("exc"))
        .alias("trt2"))
    grid = complete_grid(ev, ["date", "trt2"])
    ep = epred_cell_means(draws_table(spark, base), grid, ["date", "trt2"], grid_is_distinct=True)
    out = label_treatment(ep.withColumn("date", parse_mdy("date")).withColumn("trt", F.col("trt2")))
    return rounded(out.select("date", "trt2", "draw", "epred", "trt"))


# ---- food web without stages (D13) -------------------------------------------

# Excluded resources and resources drawn at other heights.
WEB_NOSTAGE_EXCLUDE = ["blue", "red"]
WEB_NOSTAGE_SPECIAL_Y = {"hot": 1.5, "cold": 0.5}


@query("edge_table_nostage", "WITH " + CLEAN_SQL + """,
d2 AS (SELECT species, split_part(prey_taxon, '_', 1) AS prey_taxon, mg_diet_dm FROM d),
sp AS (SELECT species, sum(mg_diet_dm) AS total_gdm FROM d2 GROUP BY species),
st AS (SELECT species, prey_taxon, sum(mg_diet_dm) AS t FROM d2 GROUP BY species, prey_taxon),
props AS (
  SELECT st.species AS consumer, st.prey_taxon AS resource, st.t / sp.total_gdm AS diet_post
  FROM st JOIN sp USING (species) WHERE st.prey_taxon NOT IN ('blue', 'red')
),
codes AS (
  SELECT *, dense_rank() OVER (ORDER BY consumer) AS cc, dense_rank() OVER (ORDER BY resource) AS rc,
         count(DISTINCT consumer) OVER () AS nc, count(DISTINCT resource) OVER () AS nr
  FROM props
)
SELECT resource, consumer, round(diet_post, 6) AS diet_post,
       round(CASE WHEN nc = 1 THEN 0.5 ELSE (cc - 1) / (nc - 1) * 0.5 + 0.25 END, 6) AS xend,
       round(CASE WHEN nr = 1 THEN 0.5 ELSE (rc - 1) / (nr - 1) END, 6) AS x,
       CAST(CASE WHEN resource = 'hot' THEN 1.5 WHEN resource = 'cold' THEN 0.5 ELSE 1.0 END AS DOUBLE) AS y,
       CAST(2.0 AS DOUBLE) AS yend,
       CASE WHEN resource LIKE '%blue%' THEN 'blue' ELSE 'non-blue' END AS color
FROM codes
""")
def q_edge_table_nostage(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.functions.strings import separate_parts
    from fieldspark.plans.foodweb import diet_proportions, edge_table

    d = diet_by_part(spark, base)
    d = d.withColumn("prey_taxon", separate_parts("prey_taxon", 1)[0])
    props = diet_proportions(d, WEB_NOSTAGE_EXCLUDE)
    e = edge_table(props, WEB_NOSTAGE_SPECIAL_Y, WEB_COLOUR[0], WEB_COLOUR[1])
    return rounded(e.select("resource", "consumer", "diet_post", "xend", "x", "y", "yend", "color"))


WEB_NOSTAGE_SQL = CLEAN_SQL + """,
d2 AS (SELECT species, split_part(prey_taxon, '_', 1) AS prey_taxon, mg_diet_dm FROM d),
sp AS (SELECT species, sum(mg_diet_dm) AS total_gdm FROM d2 GROUP BY species),
st AS (SELECT species, prey_taxon, sum(mg_diet_dm) AS t FROM d2 GROUP BY species, prey_taxon),
props AS (
  SELECT st.species AS consumer, st.prey_taxon AS resource, st.t / sp.total_gdm AS diet_post
  FROM st JOIN sp USING (species) WHERE st.prey_taxon NOT IN ('blue', 'red')
),
codes AS (
  SELECT *, dense_rank() OVER (ORDER BY consumer) AS cc, dense_rank() OVER (ORDER BY resource) AS rc,
         count(DISTINCT consumer) OVER () AS nc, count(DISTINCT resource) OVER () AS nr
  FROM props
),
ends AS (
  SELECT resource AS taxon, 'resource' AS trophic,
         CASE WHEN nr = 1 THEN 0.5 ELSE (rc - 1) / (nr - 1) END AS x,
         CAST(CASE WHEN resource = 'hot' THEN 1.5 WHEN resource = 'cold' THEN 0.5 ELSE 1.0 END AS DOUBLE) AS y
  FROM codes
  UNION ALL
  SELECT consumer, 'consumer', CASE WHEN nc = 1 THEN 0.5 ELSE (cc - 1) / (nc - 1) * 0.5 + 0.25 END, 2.0
  FROM codes
),
nodes AS (
  SELECT *, CASE WHEN taxon LIKE '%blue%' THEN 'blue' ELSE 'non-blue' END AS color FROM ends
)"""


def nostage_nodes(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.functions.strings import separate_parts
    from fieldspark.plans.foodweb import diet_proportions, edge_table, node_table

    d = diet_by_part(spark, base)
    d = d.withColumn("prey_taxon", separate_parts("prey_taxon", 1)[0])
    edges = edge_table(diet_proportions(d, WEB_NOSTAGE_EXCLUDE), WEB_NOSTAGE_SPECIAL_Y,
                       WEB_COLOUR[0], WEB_COLOUR[1])
    return node_table(edges, WEB_COLOUR[0], WEB_COLOUR[1], with_stage=False)


@query("node_table_nostage", "WITH " + WEB_NOSTAGE_SQL + """
SELECT taxon, trophic, round(x, 6) AS x, round(y, 6) AS y, color FROM nodes
""")
def q_node_table_nostage(spark: SparkSession, base: str) -> DataFrame:
    return rounded(nostage_nodes(spark, base))


@query("node_labels_nostage", "WITH " + WEB_NOSTAGE_SQL + """
SELECT taxon, trophic, round(x, 6) AS x, round(y, 6) AS y, color,
       CASE WHEN taxon LIKE '%tiny%' THEN taxon END AS prey_label,
       CASE WHEN taxon = 'tiny' THEN 'tiny parts' WHEN taxon = 'hot' THEN 'hot parts' END AS label
FROM nodes QUALIFY row_number() OVER (PARTITION BY taxon ORDER BY trophic <> 'resource', x, y) = 1
""")
def q_node_labels_nostage(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.plans.foodweb import node_labels

    return rounded(node_labels(nostage_nodes(spark, base), "tiny",
                               {"tiny": "tiny parts", "hot": "hot parts"}))


# ---- whole pipelines and edge cases --------------------------------------------

@query("clean_diet", "WITH " + CLEAN_SQL + """
SELECT id, species, date2, prey_taxon, round(mg_diet_dm, 6) AS mg_diet_dm, round(mgdm01, 6) AS mgdm01,
       round(CASE WHEN prey_mg_dm <> 0 THEN 1 / prey_mg_dm END, 9) AS prey_mg_inverse
FROM d
""")
def q_clean_diet(spark: SparkSession, base: str) -> DataFrame:
    d = clean_diet_table(spark, base)
    return rounded(d.select("id", "species", "date2", "prey_taxon", "mg_diet_dm", "mgdm01",
                            "prey_mg_inverse"), prey_mg_inverse=9)


@query("benthic_pipeline", """
WITH w AS (
  SELECT l_orderkey AS id, l_linenumber AS stat, l_linenumber + CAST(l_quantity AS INTEGER) AS chiro,
         CAST(round(l_tax * 100) AS INTEGER) AS isopod, CAST(round(l_discount * 100) AS INTEGER) AS snail
  FROM lineitem
),
long AS (
  SELECT id, stat, 'chiro' AS taxon, chiro AS abundance FROM w
  UNION ALL SELECT id, stat, 'isopod', isopod FROM w
  UNION ALL SELECT id, stat, 'snail', snail FROM w
),
mass AS (
  SELECT CASE p_type WHEN 'SMALL' THEN 'chiro' WHEN 'LARGE' THEN 'isopod' ELSE lower(p_type) END AS taxon,
         exp(ln(avg(p_retailprice))) / 1000 AS mean_mgdm
  FROM part GROUP BY p_type
  UNION ALL SELECT 'snail', 0.25
)
SELECT taxon, id, stat, abundance, round(mean_mgdm, 6) AS mean_mgdm,
       round(CAST(0.76 * 0.3 AS DOUBLE), 6) AS sample_m2,
       round(abundance * mean_mgdm / (0.76 * 0.3), 6) AS benthic_mg_dm_m2,
       round(0.01 + abundance * mean_mgdm / (0.76 * 0.3), 6) AS benthic_mg01,
       round(abundance * mean_mgdm / (0.76 * 0.3) / 1000 + 0.001, 6) AS benthic_g01
FROM long JOIN mass USING (taxon)
""")
def q_benthic_pipeline(spark: SparkSession, base: str) -> DataFrame:
    """Raw benthic columns to mass per area: larvae and pupae joined, taxon masses
    from a group-mean fit (back-transformed) and one literal row, unpivot, join."""
    from fieldspark.functions.conditionals import case_when
    from fieldspark.operators.models import cell_means
    from fieldspark.plans.biomass import add_pupae, benthic_biomass
    from fieldspark.sources.readers import add_row

    li = read_table(spark, base, "lineitem")
    raw = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("stat"),
                    F.col("l_linenumber").alias("chiro_larvae"),
                    F.round(F.col("l_tax") * 100).cast("int").alias("isopod"),
                    F.round(F.col("l_discount") * 100).cast("int").alias("snail"),
                    F.col("l_quantity").cast("int").alias("pupae"),
                    F.col("l_comment").alias("notes") if "l_comment" in li.columns
                    else F.lit("x").alias("notes"))
    wide = add_pupae(raw, drop=["notes"])
    names = {"SMALL": "chiro", "LARGE": "isopod"}
    taxon = case_when([(F.col("p_type") == F.lit(k), F.lit(v)) for k, v in names.items()],
                      F.lower("p_type"))
    fit = cell_means(read_table(spark, base, "part").withColumn("taxon", taxon), ["taxon"],
                     "p_retailprice")
    mass = add_row(fit.select("taxon", (F.exp("b") / 1000).alias("mean_mgdm")), taxon="snail",
                   mean_mgdm=0.25)
    return rounded(benthic_biomass(wide, mass, "chiro", "snail"))


@query("spider_emergence", """
WITH ev AS (
  SELECT user_id AS stat2, CAST(ts AS DATE) AS date2,
         CASE WHEN event_type = 'view' THEN 'Ambient' ELSE 'Cage' END AS trt, value FROM events
),
sp AS (SELECT stat2, trt, round(sum(value), 6) AS spid FROM ev GROUP BY stat2, trt),
em AS (SELECT stat2, date2, trt, round(sum(value), 6) AS mass FROM ev GROUP BY stat2, date2, trt)
SELECT sp.stat2, sp.trt AS trt_x, sp.spid, em.date2, em.trt AS trt_y, em.mass
FROM (SELECT * FROM sp WHERE trt <> 'Ambient') sp
LEFT JOIN (SELECT * FROM em WHERE trt <> 'Ambient'
           AND (date2 = DATE '2024-01-29' OR date2 = DATE '2024-01-30')) em ON sp.stat2 = em.stat2
""")
def q_spider_emergence(spark: SparkSession, base: str) -> DataFrame:
    import datetime

    from fieldspark.plans.spiders import spider_emergence

    ev = events(spark, base).select(
        F.col("user_id").alias("stat2"), F.to_date("ts").alias("date2"),
        F.when(F.col("event_type") == "view", "Ambient").otherwise("Cage").alias("trt"), "value")
    spiders = ev.groupBy("stat2", "trt").agg(F.round(F.sum("value"), 6).alias("spid"))
    emergence = ev.groupBy("stat2", "date2", "trt").agg(F.round(F.sum("value"), 6).alias("mass"))
    dates = [datetime.date.fromisoformat(d) for d in SURVEY_DATES]
    return spider_emergence(spiders, emergence, dates)


@query("conditional_effects", """
WITH ev AS (SELECT DISTINCT event_type AS species,
                   CASE WHEN value >= 50 THEN 'pa' ELSE 'not_pa' END AS prey_stage FROM events),
sp AS (SELECT species, row_number() OVER (ORDER BY species) - 1 AS r FROM (SELECT DISTINCT species FROM ev)),
st AS (SELECT prey_stage, row_number() OVER (ORDER BY prey_stage) - 1 AS q
       FROM (SELECT DISTINCT prey_stage FROM ev)),
g AS (SELECT *, (SELECT count(*) FROM sp) AS k FROM sp CROSS JOIN st),
ep AS (
  SELECT species, prey_stage,
         exp(CAST(e.embedding[1] AS DOUBLE)
           + CASE WHEN r > 0 THEN CAST(e.embedding[1 + r] AS DOUBLE) ELSE 0 END
           + CASE WHEN q > 0 THEN CAST(e.embedding[1 + k] AS DOUBLE) ELSE 0 END) AS epred
  FROM g CROSS JOIN embeddings e
)
SELECT species, prey_stage,
       round(quantile_cont(epred, 0.025), 6) AS q025, round(quantile_cont(epred, 0.17), 6) AS q170,
       round(quantile_cont(epred, 0.5), 6) AS q500, round(quantile_cont(epred, 0.83), 6) AS q830,
       round(quantile_cont(epred, 0.975), 6) AS q975
FROM ep GROUP BY species, prey_stage
""")
def q_conditional_effects(spark: SparkSession, base: str) -> DataFrame:
    """Main effects of species and stage; the interactions are left out."""
    from fieldspark.operators.draws import factor_levels_all
    from fieldspark.plans.summaries import conditional_effects

    cells = draw_cells(spark, base).select("species", "prey_stage")
    factors = factor_levels_all(cells, ["species", "prey_stage"])
    n = len(factors["species"])
    inter = range(1 + (n - 1) + 1, 2 * n)
    return rounded(conditional_effects(draws_table(spark, base), cells, factors,
                                       exclude_terms=list(inter)))


HURDLE_SQL = """
WITH ev AS (SELECT DISTINCT event_type AS species,
                   CASE WHEN value >= 50 THEN 'pa' ELSE 'not_pa' END AS prey_stage FROM events),
sp AS (SELECT species, row_number() OVER (ORDER BY species) - 1 AS r FROM (SELECT DISTINCT species FROM ev)),
st AS (SELECT prey_stage, row_number() OVER (ORDER BY prey_stage) - 1 AS q
       FROM (SELECT DISTINCT prey_stage FROM ev)),
g AS (SELECT *, (SELECT count(*) FROM sp) AS k FROM sp CROSS JOIN st),
eta AS (
  SELECT species, prey_stage, vec_id AS draw,
         {mu} AS eta_mu, {hu} AS eta_hu
  FROM g CROSS JOIN embeddings e
),
h AS (SELECT *, exp(eta_mu) AS mu, 1 / (1 + exp(-eta_hu)) AS hu FROM eta)
SELECT species, prey_stage, draw, round(mu, 6) AS mu, round(hu, 6) AS hu,
       round(mu * (1 - hu), 6) AS epred
FROM h
"""


def _hurdle_eta(first: str) -> str:
    at = lambda k: f"CAST(e.embedding[{first} + {k}] AS DOUBLE)"
    return (f"({at('1')} + CASE WHEN r > 0 THEN {at('1 + r')} ELSE 0 END"
            f" + CASE WHEN q > 0 THEN {at('1 + k')} ELSE 0 END"
            f" + CASE WHEN r > 0 AND q > 0 THEN {at('1 + k + r')} ELSE 0 END)")


@query("hurdle_draws", HURDLE_SQL.format(mu=_hurdle_eta("0"), hu=_hurdle_eta("2 * k")))
def q_hurdle_draws(spark: SparkSession, base: str) -> DataFrame:
    """Hurdle expectation per draw with both distributional parameters."""
    from fieldspark.operators.draws import epred_draws, factor_levels_all, treatment_design
    from fieldspark.operators.joins import complete_grid

    cells = draw_cells(spark, base).select("species", "prey_stage")
    factors = factor_levels_all(cells, ["species", "prey_stage"])
    design, terms = treatment_design(complete_grid(cells, list(factors)), factors)
    n = len(terms)
    draws = draws_table(spark, base).select(
        "draw", F.slice("coef", 1, n).alias("coef"), F.slice("coef", n + 1, n).alias("hu_coef"))
    return rounded(epred_draws(draws, design, list(factors), hurdle_coef="hu_coef"))


@query("draw_taxon_totals", "WITH " + EPRED_SQL + """
SELECT date2, draw, 'All taxa' AS "group", round(sum(epred), 6) AS total FROM ep GROUP BY date2, draw
UNION ALL
SELECT date2, draw, 'click', round(sum(epred), 6) FROM ep WHERE species = 'click' GROUP BY date2, draw
""")
def q_draw_taxon_totals(spark: SparkSession, base: str) -> DataFrame:
    """Totals over all taxa and of one taxon per draw, from one aggregate."""
    ep = events_draw_epred(spark, base)
    one = F.col("species") == "click"
    sums = ep.groupBy("date2", "draw").agg(
        strict_sum("epred").alias("all"), F.count(F.when(one, F.lit(1))).alias("n"),
        F.sum(F.when(one, F.col("epred"))).alias("one"))
    groups = F.array(F.struct(F.lit("All taxa").alias("group"), F.col("all").alias("total")),
                     F.when(F.col("n") > 0, F.struct(F.lit("click").alias("group"),
                                                     F.col("one").alias("total"))))
    e = sums.select("date2", "draw", F.explode(groups).alias("g")).where("g IS NOT NULL")
    return rounded(e.select("date2", "draw", "g.group", "g.total"))


@query("prior_table", """
WITH p AS (
  SELECT o_orderkey AS row_id, o_orderpriority AS model,
         nullif(trim(CASE WHEN o_totalprice < 150000 THEN '' ELSE o_orderstatus END), '') AS prior,
         nullif(trim(CASE WHEN o_custkey % 2 = 0 THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END), '') AS coef
  FROM orders
)
SELECT row_id, model, coef,
       last_value(prior IGNORE NULLS) OVER (PARTITION BY model ORDER BY row_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prior
FROM p
""")
def q_prior_table(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.models import prior_table

    o = read_table(spark, base, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("model"),
        F.when(F.col("o_totalprice") < 150000, F.lit("")).otherwise(F.col("o_orderstatus")).alias("prior"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit(" ")).otherwise(F.col("o_custkey").cast("string"))
        .alias("coef"))
    return prior_table(o, chunk_rows=1024)


@query("sorted_report", "WITH " + CLEAN_SQL + """,
g AS (SELECT species, prey_taxon, round(sum(mg_diet_dm), 2) AS total FROM d GROUP BY ALL)
SELECT species, prey_taxon, total,
       row_number() OVER (ORDER BY total DESC NULLS LAST, species, prey_taxon) AS by_total,
       row_number() OVER (ORDER BY species, prey_taxon) AS by_name
FROM g
""")
def q_sorted_report(spark: SparkSession, base: str) -> DataFrame:
    """A report with its positions when sorted by total (descending) and by name."""
    from fieldspark.operators.ranking import number_rows, value_range

    g = diet_by_part(spark, base).groupBy("species", "prey_taxon").agg(
        F.round(strict_sum("mg_diet_dm"), 2).alias("total"))
    chunk = F.coalesce(-value_range(g, "total"), F.lit(2**30))
    g = number_rows(g, chunk, [F.desc_nulls_last("total"), F.col("species"), F.col("prey_taxon")],
                    "by_total")
    return number_rows(g, F.substring("species", 1, 1), [F.col("species"), F.col("prey_taxon")],
                       "by_name")


@query("poisson_zero_cells", """
WITH c AS (
  SELECT l_returnflag, l_linestatus,
         CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS cnt
  FROM lineitem
)
SELECT l_returnflag, l_linestatus, count(cnt) AS n, round(avg(cnt), 6) AS mean,
       round(CASE WHEN avg(cnt) > 0 THEN ln(avg(cnt)) END, 6) AS b,
       round(CASE WHEN avg(cnt) > 0 THEN 1 / sqrt(count(cnt) * avg(cnt)) END, 6) AS se
FROM c GROUP BY l_returnflag, l_linestatus
""")
def q_poisson_zero_cells(spark: SparkSession, base: str) -> DataFrame:
    """Poisson cells that are all zero, and counts that are missing."""
    from fieldspark.operators.models import cell_means

    li = read_table(spark, base, "lineitem").select(
        "l_returnflag", "l_linestatus",
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_linenumber") != 7, F.col("l_linenumber"))
        .cast("double").alias("cnt"))
    fit = cell_means(li, ["l_returnflag", "l_linestatus"], "cnt", family="poisson")
    return rounded(fit.select("l_returnflag", "l_linestatus", "n", "mean", "b", "se"))


@query("biomass_missing_days", """
WITH m AS (
  SELECT l_orderkey AS stat, l_linenumber AS loc, CAST(l_quantity AS DOUBLE) * 0.99 AS tot,
         CASE WHEN l_linestatus = 'O' THEN NULL ELSE 0.36 END AS area,
         CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN NULL ELSE 3 END AS days
  FROM lineitem
)
SELECT stat, loc, round(tot, 6) AS tot_mg_dm,
       round(CASE WHEN area > 0 AND days > 0 THEN tot / area / days END, 6) AS tot_mg_dm_m2_d
FROM m
""")
def q_biomass_missing_days(spark: SparkSession, base: str) -> DataFrame:
    """Samples without area or exposure have a mass but no rate."""
    from fieldspark.plans.biomass import emergence_biomass

    li = read_table(spark, base, "lineitem").select(
        F.col("l_orderkey").alias("stat"), F.col("l_linenumber").alias("loc"),
        F.col("l_quantity").alias("chir"),
        F.when(F.col("l_linestatus") != "O", F.lit(0.36)).alias("area"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") != "N", 3).alias("days"))
    out = emergence_biomass(li, {"chir": ("chiro_mg_dm", 0.99)})
    return rounded(out.select("stat", "loc", "tot_mg_dm", "tot_mg_dm_m2_d"))


@query("strict_stage_totals", "WITH " + CLEAN_SQL + """,
n AS (SELECT *, nullif(mg_diet_dm, (SELECT max(mg_diet_dm) FROM d)) AS mg FROM d)
SELECT species, date2,
       CASE WHEN split_part(prey_taxon, '_', 2) IN ('bolt', 'gear') THEN 'pa' ELSE 'not_pa' END
         AS prey_stage,
       round(CASE WHEN count(*) = count(mg) THEN sum(mg) END, 2) AS mg_dmtotal
FROM n GROUP BY ALL
""")
def q_strict_stage_totals(spark: SparkSession, base: str) -> DataFrame:
    """Stage totals with a missing mass: the sums it belongs to are NULL."""
    d = clean_diet_table(spark, base, classify=True)
    top = d.agg(F.max("mg_diet_dm")).scalar()
    d = d.withColumn("mg_diet_dm", F.when(F.col("mg_diet_dm") != top, F.col("mg_diet_dm")))
    return rounded(diet_stage_totals(d, PA_STAGES, ["species", "date2"]), 2)


@query("shrunken_singletons", """
WITH e AS (SELECT event_id, CASE WHEN value > 0 THEN ln(value) END AS v FROM events)
SELECT event_id, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS n, round(v, 6) AS ybar,
       CAST(NULL AS DOUBLE) AS w, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS n_left_out
FROM e
""")
def q_shrunken_singletons(spark: SparkSession, base: str) -> DataFrame:
    """Groups of one row: no within-group variance, so no shrinkage weight."""
    from fieldspark.operators.models import shrunken_means

    out = shrunken_means(events(spark, base), "event_id", "value")
    return rounded(out.select("event_id", F.col("n").cast("int"), "ybar", "w",
                              F.col("n_left_out").cast("int")))


@query("experiment_means", """
WITH e AS (SELECT event_type AS taxon, dayname(CAST(ts AS DATE)) AS experiment,
                  CASE WHEN value > 0 THEN ln(value) END AS v FROM events),
c AS (SELECT taxon, experiment, count(v) AS n, avg(v) AS m, var_pop(v) * count(v) AS ss,
             count(*) - count(v) AS o FROM e GROUP BY ALL),
t AS (SELECT *, sum(n * m) OVER (PARTITION BY taxon) / sum(n) OVER (PARTITION BY taxon) AS tm FROM c),
b AS (SELECT experiment, sum(n) AS nb, sum(n * (m - tm)) / sum(n) AS e FROM t GROUP BY experiment),
s AS (SELECT (SELECT sum(ss) / (sum(n) - count(*)) FROM c) AS s2, var_samp(e) AS vb,
             avg(1.0 / nb) AS inv FROM b),
u AS (SELECT experiment, greatest(vb - s2 * inv, 0.0) / (greatest(vb - s2 * inv, 0.0) + s2 / nb) * e AS u
      FROM b CROSS JOIN s)
SELECT taxon, CAST(sum(n) AS BIGINT) AS n, CAST(sum(o) AS BIGINT) AS n_left_out,
       round(sum(n * (m - u)) / sum(n), 6) AS b, round(exp(sum(n * (m - u)) / sum(n)), 6) AS mean
FROM t JOIN u USING (experiment) GROUP BY taxon
""")
def q_experiment_means(spark: SparkSession, base: str) -> DataFrame:
    from fieldspark.operators.models import means_with_block_effects

    ev = events(spark, base).select(F.col("event_type").alias("taxon"), F.date_format(
        F.to_date("ts"), "EEEE").alias("experiment"), "value")
    return rounded(means_with_block_effects(ev, "taxon", "experiment", "value"))
