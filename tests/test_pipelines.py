"""Reference-shaped pipelines on own synthetic rows (FIXTURES.md schemas)."""

import datetime
import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fieldspark.plans.biomass import benthic_biomass, cage_comparison, emergence_biomass
from fieldspark.plans.community import community_totals
from fieldspark.plans.diet import (
    clean_diet, clean_prey_names, diet_stage_totals, diet_stage_wide, lump_rare_prey,
)
from fieldspark.plans.foodweb import diet_proportions, edge_table, node_labels, node_table
from fieldspark.plans.spiders import label_treatment, recode_treatment, spider_emergence
from fieldspark.plans.summaries import plot_ready_draws, species_means_bydate, species_means_global
from fieldspark.sources.readers import add_row, clean_names, read_csv_typed
from fieldspark.sources.schemas import EMERGENCE, WATER_QUALITY


def _diet(spark):
    d = datetime.date
    data = [
        (1, d(2017, 6, 13), "bluegill", "chiro_l", 2.0, 0.1, "gut"),
        (1, d(2017, 6, 13), "bluegill", "chiro_ad", 1.0, 0.2, "gut"),
        (1, d(2017, 6, 13), "bluegill", "corixid", 0.5, 0.3, "gut"),
        (2, d(2017, 6, 13), "river_shiner", "chiro_p", 3.0, 0.1, "gut"),
        (2, d(2017, 6, 13), "river_shiner", "zoop", 0.0, 0.0, "gut"),
        (3, d(2017, 6, 23), "quillback", "chiro_l", 9.0, 0.1, "gut"),
        (4, d(2017, 6, 23), "spotfin", "unk_ins_a", 1.5, 0.1, "gut"),
    ]
    return spark.createDataFrame(data, "id int, date2 date, species string, prey_taxon string, "
                                       "mg_diet_dm double, prey_mg_dm double, method string")


RULES = [("unk_ins", "unidentified"), ("corixid", "corixidae"), ("zoop", "zooplankton")]


def test_clean_diet(spark):
    d = clean_diet(_diet(spark), ["quillback"], [("river_shiner", "rivershiner")], RULES, {"ad": "a"})
    out = rows(d, ["id", "prey_taxon"])
    assert [(r["species"], r["prey_taxon"]) for r in out] == [
        ("bluegill", "chiro_a"), ("bluegill", "chiro_l"), ("bluegill", "corixidae_unknown"),
        ("rivershiner", "chiro_p"), ("rivershiner", "zooplankton_unknown"),
        ("spotfin", "unidentified_a")]
    assert out[0]["mgdm01"] == 1.01
    assert out[4]["prey_mg_inverse"] is None   # zero prey mass: NULL, not an ANSI error
    # the split version applied to a dimension gives the same names
    same = clean_prey_names(_diet(spark), ["quillback"], [("river_shiner", "rivershiner")], RULES,
                            {"ad": "a"})
    assert sorted(r["prey_taxon"] for r in same.collect()) == sorted(r["prey_taxon"] for r in out)


def test_diet_totals_wide_and_lump(spark):
    d = clean_diet(_diet(spark), ["quillback"], [], RULES, {"ad": "a"})
    tot = {(r["id"], r["prey_stage"]): r["mg_dmtotal"] for r in diet_stage_totals(d).collect()}
    assert tot == {(1, "pa"): 1.0, (1, "not_pa"): 2.5, (2, "pa"): 3.0, (2, "not_pa"): 0.0,
                   (4, "pa"): 1.5}
    wide = {r["id"]: (r["pa"], r["not_pa"], r["prop_pa"]) for r in diet_stage_wide(d).collect()}
    assert wide[4] == (1.5, 0.0, 1.0) and wide[1] == (1.0, 2.5, 1.0 / 3.5)
    lumped = lump_rare_prey(d, threshold=0.2, keep=["chiro_a"])
    names = {r["prey_taxon_grouped"] for r in lumped.collect()}
    assert names == {"chiro_a", "chiro_l", "chiro_p", "other_unknown"}


def test_emergence_biomass_formula(spark):
    data = [(1, "05/28/17", 10, 20, "pre", "Above", "Ambient", "ctrl", 3, 0.36, 100, 50, 40, None,
             2, 1, None, None, None, 1, None)]
    df = spark.createDataFrame(data, EMERGENCE)
    r = emergence_biomass(df).first()
    tot = 40 * 0.99 + 2 * 0.65 + 0 * 0.8 + 1 * 6.2 + 1 * 1.1
    assert math.isclose(r["tot_mg_dm"], tot) and math.isclose(r["tot_mg_dm_m2_d"], tot / 0.36 / 3)
    assert r["id"] == "10_Above" and r["cera"] == 0


def test_benthic_unpivot_join(spark):
    wide = spark.createDataFrame([("6/2/2017", 14, "above", 3, 0, 5)],
                                 "date string, id int, location string, ceratopogonidae int, "
                                 "corixidae int, chironomidae int")
    mass = add_row(spark.createDataFrame([("chironomidae", 0.5), ("corixidae", 2.0)],
                                         "taxon string, mean_mgdm double"), taxon="tipulidae", mean_mgdm=1.4)
    out = rows(benthic_biomass(wide, mass, "ceratopogonidae", "chironomidae"), ["taxon"])
    assert [r["taxon"] for r in out] == ["chironomidae", "corixidae"]
    assert math.isclose(out[0]["benthic_mg_dm_m2"], 5 * 0.5 / (0.76 * 0.3))
    assert math.isclose(out[0]["benthic_g01"], out[0]["benthic_mg_dm_m2"] / 1000 + 0.001)


def test_community_totals_hidden_date(spark):
    d = datetime.date
    obs = spark.createDataFrame(
        [(d(2017, 5, 31), "bluegill", 9), (d(2017, 6, 12), "bluegill", 20), (d(2017, 6, 23), "bluegill", 8),
         (d(2017, 6, 30), "bluegill", 3), (d(2017, 6, 30), "bluegill", 0), (d(2017, 6, 12), "gar", 1),
         (d(2017, 6, 23), "river_shiner", 0)], "date date, species string, abund int")
    observed = community_totals(obs, drop_date=d(2017, 5, 31))
    assert observed.where("species = 'gar'").count() == 1    # only observed combinations by default
    out = community_totals(obs, snap={d(2017, 6, 12): d(2017, 6, 13)}, drop_date=d(2017, 5, 31),
                           rename={"river_shiner": "rivershiner"}, complete=True)
    got = {(r["date2"], r["species"]): (r["total_abund_raw"], r["average"], r["total_abund"])
           for r in out.collect()}
    assert got[(d(2017, 6, 13), "bluegill")] == (20, 10.0, 20.0)
    assert got[(d(2017, 6, 23), "gar")] == (0, 0.25, 0.25)        # completed grid, zero imputed
    assert got[(d(2017, 6, 30), "rivershiner")] == (0, 0.0, 0.0)  # zero on every date
    assert all(k[0] != d(2017, 5, 31) for k in got)


def test_missing_values_in_pipelines(spark):
    """NULL masses make their sums NULL; no area or exposure gives no rate."""
    d = _diet(spark).withColumn("mg_diet_dm", F.when(F.col("prey_taxon") != "chiro_ad",
                                                     F.col("mg_diet_dm")))
    tot = {(r["id"], r["prey_stage"]): r["mg_dmtotal"] for r in diet_stage_totals(
        clean_diet(d, [], [], RULES, {"ad": "a"})).collect()}
    assert tot[(1, "pa")] is None and tot[(1, "not_pa")] == 2.5
    wide = {r["id"]: (r["pa"], r["total"]) for r in diet_stage_wide(
        clean_diet(d, [], [], RULES, {"ad": "a"})).collect()}
    assert wide[1] == (None, None) and wide[3] == (0.0, 9.0)
    e = spark.createDataFrame([(1, "a", 4, None, 3), (2, "b", 4, 0.5, 0), (3, "c", None, 0.5, 2)],
                              "stat int, loc string, chir int, area double, days int")
    out = {r["stat"]: r for r in emergence_biomass(e, {"chir": ("m", 2.0)}).collect()}
    assert [out[k]["tot_mg_dm_m2_d"] for k in (1, 2, 3)] == [None, None, 0.0]
    assert out[1]["tot_mg_dm"] == 8.0


def test_spider_recode_and_join(spark):
    sp = spark.createDataFrame([("6/16/2017", 1, 11, "Above", "Ambient", "fish", 2),
                                ("6/16/2017", 2, 12, "Above", "Exclusion", "no fish", 0),
                                ("6/23/2017", 3, 12, "Below", "Cage Control", "fish", 4)],
                               "date string, stat int, stat2 int, loc string, trt string, "
                               "treatment string, spid int")
    rec = rows(recode_treatment(sp), ["stat"])
    assert [(r["trt"], r["spid01"]) for r in rec] == [("exc", 0.01), ("ctrl", 4.01)]
    assert label_treatment(recode_treatment(sp)).where("trt = 'fish'").count() == 1
    em = spark.createDataFrame([(datetime.date(2017, 6, 16), 12, "Exclusion", 5.0),
                                (datetime.date(2017, 6, 23), 12, "Exclusion", 7.0),
                                (datetime.date(2017, 6, 2), 12, "Exclusion", 1.0)],
                               "date2 date, stat2 int, trt string, tot double")
    sp2 = sp.withColumn("date2", F.to_date("date", "M/d/yyyy"))
    j = spider_emergence(sp2, em, [datetime.date(2017, 6, 16), datetime.date(2017, 6, 23)])
    assert j.count() == 2 * 2 and "trt_x" in j.columns and "date2_y" in j.columns


def test_food_web_tables(spark):
    d = clean_diet(_diet(spark), ["quillback"], [("river_shiner", "rivershiner")], RULES, {"ad": "a"})
    props = diet_proportions(d, exclude=["zooplankton", "unidentified"])
    edges = edge_table(props, {"chiro_p": 1.5}, "chiro", ("chironomid", "non-chironomid"))
    e = {(r["consumer"], r["resource"]): r for r in edges.collect()}
    assert math.isclose(e[("bluegill", "chiro_l")]["diet_post"], 2.0 / 3.5)
    assert e[("rivershiner", "chiro_p")]["y"] == 1.5 and e[("bluegill", "chiro_l")]["y"] == 1.0
    assert {r["xend"] for r in edges.collect()} == {0.25, 0.5, 0.75}
    nodes = node_table(edges, "chir", ("chironomid", "non-chironomid"))
    assert nodes.count() == 2 * edges.count()
    n = {r["taxon"]: r for r in nodes.collect()}
    assert n["chiro-l"]["stage"] == "l" and n["chiro-l"]["trophic"] == "resource"
    assert n["spotfin"]["y"] == 2.0 and n["spotfin"]["stage"] == "unknown"
    both = nodes.unionByName(nodes.where("taxon = 'spotfin'").withColumn("trophic", F.lit("resource")))
    assert node_labels(both, "x", {}).where("taxon = 'spotfin'").first()["trophic"] == "resource"
    scored = node_table(edges.withColumn("consumer", F.concat("consumer", F.lit("_x"))), "chir", ("a", "b"))
    assert scored.where("taxon = 'spotfin_x' AND x IS NOT NULL").count() > 0
    labels = {r["taxon"]: r for r in node_labels(nodes, "chiro", {"chiro-l": "larvae"}).collect()}
    assert labels["chiro-l"]["label"] == "larvae" and labels["spotfin"]["prey_label"] is None


def test_summaries_and_plot_ready(spark):
    d = datetime.date
    posts = spark.createDataFrame(
        [(lv, sp, d(2017, 6, 13), k, 0.1 * k, 10.0 * k) for lv in ("Per capita", "Per population")
         for sp in ("Bluegill", "Spotfin Shiner") for k in range(1, 401)],
        "data_level string, species string, date2 date, draw long, prop_pa double, total double")
    g = {(r["data_level"], r["species"], r["name"]): r for r in species_means_global(posts).collect()}
    assert g[("Per capita", "All Species", "total")]["median"] == 2005.0
    b = species_means_bydate(posts, scale={"total": 1000})
    assert b.count() == 2 * 3 * 2
    p = plot_ready_draws(posts, 300, ["Spotfin Shiner"], {"Spotfin Shiner": 0.5},
                         {"population": "b) Per Population", "capita": "c) Per capita"})
    r = p.where("species = 'Spotfin Shiner'").first()
    assert p.count() == 4 * 300 and r["species_level"] == 1
    assert r["date_dodged"] == datetime.datetime(2017, 6, 13, 12)


def test_csv_reader_nulls_and_clean_names(spark, tmp_path):
    f = tmp_path / "wq.csv"
    f.write_text('date,id,location,trt,pH,cond_uS,temp_C,depth_cm,do_mgL\n'
                 '7-Jun-17,1,above,ctrl,7.1,NA,20.5,,8\n'
                 ',,,"",,,,,\n')
    df = read_csv_typed(spark, str(f), WATER_QUALITY)
    out = rows(df)
    assert out[0]["cond_uS"] is None and out[0]["depth_cm"] is None and out[0]["pH"] == 7.1
    assert all(v is None for v in out[1].values())
    assert clean_names(df).columns == ["date", "id", "location", "trt", "p_h", "cond_u_s", "temp_c",
                                       "depth_cm", "do_mg_l"]
    swapped = tmp_path / "swapped.csv"
    swapped.write_text('id,date,location,trt,pH,cond_uS,temp_C,depth_cm,do_mgL\n1,7-Jun-17,,,,,,,\n')
    with pytest.raises(ValueError, match="header"):
        read_csv_typed(spark, str(swapped), WATER_QUALITY)
    g = tmp_path / "raw.csv"
    g.write_text('...1,mm,date\n1,2.5,5/28/2017\n2,NA,\n')
    inferred = read_csv_typed(spark, str(g), None)
    assert inferred.columns == ["...1", "mm", "date"]
    assert dict(inferred.dtypes)["mm"] == "double" and inferred.where("mm IS NULL").count() == 1
    cc = cage_comparison(spark.createDataFrame([("d1", "Ambient", 3, 1), ("d1", "Exclusion", 9, 9)],
                                               "date string, trt string, chir int, doli int"),
                         ["date", "trt"])
    assert {r["taxon"]: r["taxon_order"] for r in cc.collect()} == {"chir": 1, "doli": 2}
