"""Aggregates of cell layers over catchments, and the tables built from them.

``member`` is (outlet, id): catchments may overlap, so membership is a table and every block is one join and one group-by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hydrology as H
from ..sources.grids import cut
from .ranks import quantiles


def cn_table(spark, numbers: dict = H.CURVE_NUMBERS) -> DataFrame:
    """(lc_class, hsg 1-4, cn): one row a class and soil group."""
    return spark.createDataFrame([(k, i + 1, float(v)) for k, row in numbers.items() for i, v in enumerate(row)], "lc_class int, hsg int, cn double")


def curve_number(cells: DataFrame, table: DataFrame) -> DataFrame:
    """``cells`` (lc_class, hsg) with cn; dual groups (14) count as D, unknown ones are null."""
    group = F.when(F.col("hsg") == 14, 4).otherwise(F.col("hsg"))
    return cells.withColumn("_g", group).join(table.withColumnRenamed("hsg", "_g"), ["lc_class", "_g"], "left").drop("_g")


def runoff_block(cells: DataFrame, member: DataFrame, condition: str = "II") -> DataFrame:
    """Mean curve number (and that of the antecedent ``condition``) with its coverage, the mean of a runoff coefficient ``rc`` if there is one, and land-cover shares of the known cells in nine groups."""
    own = member.join(cells, "id")
    known = F.count(F.when(F.col("lc_class") > 0, 1))
    shares = [(100 * F.sum(F.coalesce(F.col("lc_class").isin(*codes), F.lit(False)).cast("int")) / known).alias(f"lc_pct_{k}") for k, codes in H.COVER_GROUPS.items()]
    rc = [F.avg("rc").alias("rational_c"), (100 * F.count("rc") / F.count("*")).alias("rc_coverage_pct")] if "rc" in cells.columns else []
    got = own.groupBy("outlet").agg(F.avg("cn").alias("cn_ii"), (100 * F.count("cn") / F.count("*")).alias("cn_coverage_pct"), *rc, *shares)
    return got.withColumn("cn_export", H.amc(F.col("cn_ii"), condition))


def scenario_block(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of the mean curve number (and runoff coefficient) between two runoff blocks, and the shares after."""
    extra = "rational_c" in before.columns and "rational_c" in after.columns
    shares = [c for c in after.columns if c.startswith("lc_pct_")]
    b = before.select("outlet", F.col("cn_ii").alias("cn_base"), *([F.col("rational_c").alias("rc_base")] if extra else []))
    a = after.select("outlet", F.col("cn_ii").alias("cn_scenario"), F.col("cn_export").alias("cn_export_scenario"), *([F.col("rational_c").alias("rc_scenario")] if extra else []), *[F.col(c).alias(f"{c}_scn") for c in shares])
    out = b.join(a, "outlet").withColumn("cn_change", F.col("cn_scenario") - F.col("cn_base"))
    return out.withColumn("rc_change", F.col("rc_scenario") - F.col("rc_base")) if extra else out


def scenario_loss(cells: DataFrame, member: DataFrame) -> DataFrame:
    """Soil loss under a change of cover: a_loss x c_scn / c_factor per cell (where c_factor > 0), its mean and the change against the same cells before."""
    own = member.join(cells, "id").withColumn("a_scn", F.when(F.col("c_factor") > 0, F.col("a_loss") * F.col("c_scn") / F.col("c_factor")))
    both = F.when(F.col("a_scn").isNotNull(), F.col("a_loss"))
    return own.groupBy("outlet").agg(F.avg("c_scn").alias("c_mean_scn"), F.avg("a_scn").alias("a_mean_scn"), (F.avg("a_scn") - F.avg(both)).alias("a_change"))


def rain_block(cells: DataFrame, member: DataFrame, names: DataFrame, threshold_pct: float = 80.0) -> DataFrame:
    """Shares of rain zones (of the cells that have one) as JSON, the dominant one (ties by lower-cased name, then name), coverage, mean precipitation and erosivity;
    ``zone_doubtful`` where the dominant zone covers less than ``threshold_pct``."""
    own = member.join(cells.select("id", "zone", "map_mm"), "id")
    by = own.filter("zone is not null").groupBy("outlet", "zone").agg(F.count("*").alias("n")).join(names, "zone", "left").withColumn("name", F.coalesce("name", F.col("zone").cast("string")))
    by = by.groupBy("outlet", "name").agg(F.sum("n").alias("n"))  # zones of one name are one
    order = F.struct((-F.col("n")).alias("n"), F.lower("name").alias("l"), "name")
    zones = by.groupBy("outlet").agg(F.sort_array(F.collect_list(order)).alias("z"), F.sum("n").alias("total"))
    pct = lambda x: 100 * (-x["n"]) / F.col("total")
    zones = zones.select(
        "outlet", F.col("z")[0]["name"].alias("rain_zone"), pct(F.col("z")[0]).alias("rain_zone_pct"), F.size("z").cast("long").alias("n_zones"),
        F.concat(F.lit("{"), F.array_join(F.transform("z", lambda x: F.concat(F.to_json(F.array(x["name"])).substr(F.lit(2), F.length(F.to_json(F.array(x["name"]))) - 2), F.lit(": "), F.round(pct(x), 3).cast("string"))), ", "), F.lit("}")).alias("rain_zones_json"),
    )
    means = own.groupBy("outlet").agg((100 * F.count("zone") / F.count("*")).alias("rain_zone_coverage_pct"), F.avg("map_mm").alias("map_mm"), (100 * F.count("map_mm") / F.count("*")).alias("map_coverage_pct"), F.avg(H.rainfall_erosivity(F.col("map_mm"))).alias("r_factor"))
    return means.join(zones, "outlet", "left").withColumn("zone_doubtful", F.coalesce(F.col("rain_zone_pct") < threshold_pct, F.lit(False)))


def check_rain(cells: DataFrame, low_mm: float = 5.0, high_mm: float = 12000.0) -> DataFrame:
    """One row: the greatest annual rainfall and its verdict: ``empty``, ``daily or monthly``, ``above the record``, ``negative``, ``doubtful`` (at most 100 mm) or ``ok``."""
    got = cells.agg(F.min("map_mm").alias("least")).join(quantiles(cells, {"most": (F.col("map_mm"), 0.995)}))  # a row each
    verdict = F.when(F.col("most").isNull(), "empty").when(F.col("least") < 0, "negative").when(F.col("most") < low_mm, "daily or monthly").when(F.col("most") > high_mm, "above the record").when(F.col("most") < 100, "doubtful").otherwise("ok")
    return got.withColumn("verdict", verdict)


def soil_properties(units: DataFrame) -> DataFrame:
    """Texture, soil group and both erodibilities of soil units (sand, silt, clay, oc_pct)."""
    s, i, c, o = (F.col(x) for x in ("sand", "silt", "clay", "oc_pct"))
    out = units.withColumn("texture", H.usda_texture(s, i, c)).withColumn("k_williams", H.williams_k(s, i, c, o)).withColumn("k_diameter", H.diameter_k(s, i, c))
    return out.withColumn("hsg", H.hsg_of_texture(F.col("texture")))


def depth_weighted(layers: DataFrame, top: float, bottom: float, value: str) -> DataFrame:
    """(unit, value): mean of layers (unit, top, bottom, value) by their overlap with the interval; layers without a value are left out."""
    overlap = F.least(F.col("bottom"), F.lit(float(bottom))) - F.greatest(F.col("top"), F.lit(float(top)))
    own = layers.withColumn("w", overlap).filter((F.col("w") > 0) & F.col(value).isNotNull() & (F.col(value) >= 0))
    return own.groupBy("unit").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))


def soil_block(cells: DataFrame, member: DataFrame, units: DataFrame) -> DataFrame:
    """Coverage, area-weighted means, the dominant unit (ties by name), texture, drainage and soil-group shares of the known cells; dual groups (14) count as D and are given as such."""
    own = member.join(cells.select("id", "soil_unit"), "id").join(units, "soil_unit", "left")
    covered = own.filter("k_williams is not null")
    by = covered.groupBy("outlet", "soil_unit").agg(F.count("*").alias("n"), F.first("drain").alias("drain") if "drain" in units.columns else F.lit(None).cast("string").alias("drain"))
    dominant = by.groupBy("outlet").agg(F.min(F.struct((-F.col("n")).alias("n"), "soil_unit")).alias("d"), F.count("*").alias("soil_units")).select("outlet", F.col("d.soil_unit").alias("dominant_unit"), "soil_units")
    drained = by.filter("drain <> ''").groupBy("outlet", "drain").agg(F.sum("n").alias("n"), F.min("soil_unit").alias("first")).groupBy("outlet").agg(F.min_by("drain", F.struct((-F.col("n")).alias("n"), "first")).alias("drain_class"))
    number = F.when(F.col("hsg").isin("A", "B", "C", "D"), F.expr("position(hsg, 'ABCD')")).otherwise(F.col("hsg").try_cast("int"))
    shares = [(100 * F.sum(F.when(number.isin(*codes), 1).otherwise(0)) / F.count(F.when(number > 0, 1))).alias(f"hsg_pct_{g}") for g, codes in (("a", (1,)), ("b", (2,)), ("c", (3,)), ("d", (4, 14)), ("dual", (14,)))]
    groups = own.groupBy("outlet").agg((100 * F.count("k_williams") / F.count("*")).alias("soil_coverage_pct"), *shares)
    means = covered.groupBy("outlet").agg(*[F.avg(x).alias(x) for x in ("sand", "silt", "clay", "oc_pct", "k_williams", "k_diameter")], *[F.avg(x).alias(x) for x in ("bulk", "cfrag") if x in units.columns])
    out = groups.join(means, "outlet", "left").join(dominant, "outlet", "left").join(drained, "outlet", "left")
    out = out.withColumn("texture", H.usda_texture(F.col("sand"), F.col("silt"), F.col("clay"))).withColumn("hsg_proxy", H.hsg_of_texture(F.col("texture"), F.col("drain_class")))
    most = F.greatest(*[F.col(f"hsg_pct_{g}") for g in "abcd"])
    dom = F.when(F.col("hsg_pct_a") == most, "A").when(F.col("hsg_pct_b") == most, "B").when(F.col("hsg_pct_c") == most, "C").when(F.col("hsg_pct_d") == most, "D")
    out = out.withColumn("hsg", dom)
    return out.withColumn("rock_factor", H.rock_factor(F.col("cfrag"))) if "cfrag" in units.columns else out


def combine_components(components: DataFrame, layers: DataFrame, top: float = 0.0, bottom: float = 20.0) -> DataFrame:
    """Soil units from their components (unit, profile, share) and profile layers (profile, top, bottom, sand, silt, clay, oc_pct, bulk, cfrag, drain).

    Layers are weighed by their overlap with the depth interval, components that have an erodibility by their share; negative values are missing. The drainage
    class and the dominant profile are those of the greatest share (ties by drainage letter or profile).
    """
    props = ("sand", "silt", "clay", "oc_pct", "bulk", "cfrag")
    overlap = F.least(F.col("bottom"), F.lit(float(bottom))) - F.greatest(F.col("top"), F.lit(float(top)))
    own = layers.withColumn("w", overlap).filter("w > 0")
    mean = lambda x, w: F.sum(F.when(H.given(F.col(x)), F.col(w) * F.col(x))) / F.sum(F.when(H.given(F.col(x)), F.col(w)))
    profile = own.groupBy("profile").agg(*[mean(x, "w").alias(x) for x in props], F.min_by("drain", F.when(F.col("drain").isNotNull(), F.col("top"))).alias("drain"))
    profile = profile.withColumn("k_williams", H.williams_k(*[F.col(x) for x in ("sand", "silt", "clay", "oc_pct")])).withColumn("k_diameter", H.diameter_k(*[F.col(x) for x in ("sand", "silt", "clay")]))
    parts = components.filter("share > 0 and profile is not null").join(profile, "profile", "left")
    good = parts.filter("k_williams is not null")
    out = good.groupBy("unit").agg(*[mean(x, "share").alias(x) for x in (*props, "k_williams", "k_diameter")], F.sum("share").alias("good"), F.min_by("profile", F.struct((-F.col("share")).alias("s"), "profile")).alias("dominant_profile"))
    drain = good.filter("drain is not null").groupBy("unit", "drain").agg(F.sum("share").alias("s")).groupBy("unit").agg(F.min_by("drain", F.struct((-F.col("s")).alias("s"), "drain")).alias("drain"))
    totals = parts.groupBy("unit").agg(F.sum("share").alias("total"), F.count("*").alias("n_components"))
    out = totals.join(out, "unit", "left").join(drain, "unit", "left").withColumn("share_with_data", 100 * F.coalesce("good", F.lit(0.0)) / F.col("total"))
    out = out.withColumn("texture", H.usda_texture(F.col("sand"), F.col("silt"), F.col("clay")))
    return out.withColumn("hsg", H.hsg_of_texture(F.col("texture"), F.col("drain"))).drop("good", "total")


def soil_cells(cells: DataFrame, units: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """Soil values of cells (id, soil_unit): those of the unit, unless ``direct`` (id and any of sand, silt, clay, oc_pct, hsg, k_williams) gives its own; what is computed follows."""
    out = cells.select("id", "soil_unit").join(units.select("soil_unit", "sand", "silt", "clay", "oc_pct", *([F.col("drain")] if "drain" in units.columns else [])), "soil_unit", "left")
    held = set()
    if direct is not None:
        held = set(direct.columns) - {"id"}
        out = out.join(direct.select("id", *[F.col(c).alias(f"_{c}") for c in held]), "id", "left")
        out = out.withColumns({c: F.coalesce(f"_{c}", c) for c in ("sand", "silt", "clay", "oc_pct") if c in held})
    out = out.withColumn("texture", H.usda_texture(F.col("sand"), F.col("silt"), F.col("clay")))
    k = H.williams_k(*[F.col(x) for x in ("sand", "silt", "clay", "oc_pct")])
    group = H.hsg_of_texture(F.col("texture"), F.col("drain") if "drain" in units.columns else None)
    number = F.when(group == "A", 1).when(group == "B", 2).when(group == "C", 3).when(group == "D", 4)
    out = out.withColumn("k_williams", F.coalesce("_k_williams", k) if "k_williams" in held else k).withColumn("hsg", F.coalesce(F.when(F.col("_hsg") > 0, F.col("_hsg")), number) if "hsg" in held else number)
    return out.drop(*[f"_{c}" for c in held])


def erosion_layers(cells: DataFrame, cw: float, ch: float) -> DataFrame:
    """Adds area_m, spi, ln_spi, twi, ls and sti (null on channels, ``channel``) to cells (acc, slope)."""
    a, s = F.col("area_m"), F.col("slope")
    out = cells.withColumn("area_m", H.specific_area(F.col("acc"), cw, ch))
    out = out.withColumn("spi", H.spi(a, s)).withColumn("ln_spi", F.log(H.spi(a, s))).withColumn("twi", H.twi(a, s)).withColumn("ls", H.ls_factor(a, s))
    return out.withColumn("sti", F.when(~F.col("channel"), H.sti(a, s)))


def soil_loss(cells: DataFrame) -> DataFrame:
    """Adds a_loss = R K LS C P; P is 1 where unknown, any other missing factor gives null."""
    return cells.withColumn("a_loss", F.col("r_factor") * F.col("k_factor") * F.col("ls") * F.col("c_factor") * F.coalesce("p_factor", F.lit(1.0)))


def check_factor(cells: DataFrame, factor: str, low: float, high: float) -> DataFrame:
    """One row: extent, median and 99.5 % quantile of a factor, the share of land-cover codes among its values, and whether it leaves its plausible range."""
    code = F.avg(F.when(F.col(factor).isNotNull(), F.col(factor).isin(*[float(x) for x in H.COVER_C]).cast("double")))
    got = cells.agg(F.min(factor).alias("least"), F.max(factor).alias("most"), F.count(factor).alias("n"), code.alias("code_share")).join(quantiles(cells, {"median": (F.col(factor), 0.5), "p995": (F.col(factor), 0.995)}))  # a row each
    return got.withColumn("implausible", (F.col("least") < low) | (F.col("p995") > high))


def factor_verdict(checked: DataFrame, name: str) -> DataFrame:
    """``checked`` (a row of ``check_factor``) with the likely mistake of factor R, K, C or P: ``empty``, ``negative``, ``class codes``, ``US units``, ``out of range``, ``low`` or ``ok``."""
    low, high = H.FACTOR_RANGES[name]
    v = F.when(F.col("n") == 0, "empty").when(F.col("least") < low - 1e-9, "negative")
    if name in ("C", "P"):
        v = v.when((F.col("p995") > high + 1e-6) & (F.col("code_share") >= 0.8), "class codes").when(F.col("p995") > high + 1e-6, "out of range")
    elif name == "K":
        v = v.when((F.col("p995") > high) & (F.col("p995") <= 0.8), "US units").when(F.col("p995") > high, "out of range").when(F.col("p995") < 0.001, "low")
    else:
        v = v.when(F.col("p995") > high, "out of range").when(F.col("median") < 200, "low")
    return checked.withColumn("verdict", v.otherwise("ok"))


def cover_factor(cells: DataFrame, values: dict, default: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``cells`` (lc_class) with ``factor`` by class, and the classes that have none with their numbers of cells."""
    out = cells.withColumn("factor", H.lookup(F.col("lc_class"), values, default))
    return out, cells.filter(F.col("lc_class").isNotNull() & ~F.col("lc_class").isin(*values)).groupBy("lc_class").agg(F.count("*").alias("n_cells"))


def percentile_breaks(cells: DataFrame, column: str, shares=(0.5, 0.75, 0.9, 0.97)) -> DataFrame:
    """One row of class breaks, each pushed just above the one before where they tie."""
    q = quantiles(cells, {f"q{k}": (F.col(column), p) for k, p in enumerate(shares)}).select(F.array(*[f"q{k}" for k in range(len(shares))]).alias("q"))
    breaks = F.aggregate("q", F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, F.greatest(x, F.element_at(acc, -1) + 1e-9)).otherwise(x))))
    return q.select(*[F.get(breaks, F.lit(i)).alias(f"break_{i + 1}") for i in range(len(shares))])


def class_extents(cells: DataFrame, column: str, cell_area_km2: float) -> DataFrame:
    """Cells, area and share of each class, on channels, on hillslopes and in all."""
    grouped = cells.filter(F.col(column).isNotNull()).rollup(column, "channel").agg(F.count("*").alias("n_cells"), F.grouping_id().alias("g"))
    total = F.max(F.when(F.col("g") == 3, F.col("n_cells"))).over(Window.partitionBy())
    rows = grouped.withColumn("pct", 100 * F.col("n_cells") / total).filter("g < 3")
    part = F.when(F.col("g") == 1, "all").when(F.col("channel"), "channel").otherwise("hillslope")
    return rows.select(F.col(column).alias("class"), part.alias("part"), "n_cells", (F.col("n_cells") * cell_area_km2).alias("area_km2"), "pct")


def erosion_classes(cells: DataFrame, spi: str = "spi_fixed", loss: str = "soil_loss", matrix=None) -> DataFrame:
    """Adds the scores of stream power (``spi_score``) and soil loss (``loss_score``) and both combined (``score``); 0 without."""
    (sb, _, ss), (lb, _, ls) = H.SCHEMES[spi], H.SCHEMES[loss]
    out = cells.withColumn("spi_score", H.score_of(H.classify(F.col("ln_spi"), list(sb)), ss)).withColumn("loss_score", H.score_of(H.classify(F.col("a_loss"), list(lb)), ls))
    return out.withColumn("score", H.combine_scores(F.col("spi_score"), F.col("loss_score"), matrix))


def erosion_block(cells: DataFrame, member: DataFrame, cell_area_km2: float, bulk: float = 1400.0) -> DataFrame:
    """Soil loss and indices of each catchment: means, 90 % quantiles, shares of the combined scores (if ``cells`` has ``score``), gross erosion, delivery, yield and their classes.

    Stream power is that of the channel cells; the composite is null if one of its three scores is missing.
    """
    own = cut(member.join(cells, "id"), "erosion-members")
    shares = [(100 * F.sum((F.col("score") == k).cast("int")) / F.count(F.when(F.col("score") > 0, 1))).alias(f"pct_s{k}") for k in range(1, 6)] if "score" in cells.columns else []
    factors = [F.avg(c).alias(f"{c[0]}_mean") for c in ("k_factor", "c_factor", "p_factor") if c in cells.columns]
    got = own.groupBy("outlet").agg(F.avg("a_loss").alias("a_mean"), F.avg("ls").alias("ls_mean"), (F.count("*") * cell_area_km2).alias("area_km2"), *shares, *factors)
    high = quantiles(own, {"a_p90": (F.col("a_loss"), 0.9), "ls_p90": (F.col("ls"), 0.9), "ln_spi_p90": (F.when(F.col("channel"), F.col("ln_spi")), 0.9)}, ("outlet",))
    got = got.join(high, "outlet", "left")
    got = got.withColumn("gross_t", F.coalesce("a_mean", F.lit(0.0)) * F.col("area_km2") * 100).withColumn("sdr", H.sediment_delivery(F.col("area_km2"))).withColumn("yield_t", F.col("gross_t") * F.col("sdr"))
    got = got.withColumn("yield_m3", F.col("yield_t") * 1000 / bulk)
    loss, volume = H.classify(F.col("a_mean"), list(H.SCHEMES["soil_loss"][0])), H.classify(F.col("yield_m3"), list(H.SCHEMES["volume"][0]))
    got = got.withColumn("loss_class", H.name_of(loss, H.FIVE)).withColumn("loss_score", H.score_of(loss, H.SCHEMES["soil_loss"][2]))
    got = got.withColumn("volume_class", H.name_of(volume, H.SCHEMES["volume"][1])).withColumn("volume_score", H.score_of(volume, H.SCHEMES["volume"][2]))
    spi = H.score_of(H.classify(F.col("ln_spi_p90"), list(H.SCHEMES["spi_fixed"][0])), H.SCHEMES["spi_fixed"][2])
    return got.withColumn("composite", H.composite(spi, F.col("loss_score"), F.col("volume_score"))).withColumn("impact", H.impact_level(F.col("composite")))


def tc_block(rows: DataFrame) -> DataFrame:
    """Times of concentration (minutes) by five methods, each with its flag: ``within``, ``outside: ...`` or null without the method.

    ``rows`` has lfp_length_m, lfp_slope_1085, lfp_overland_m, lfp_overland_slope, area_km2, cn_ii, catch_slope_horn and, if known, lfp_channel_m,
    lfp_channel_slope, kerby_n, sheet_n, p2_mm, xs_area_m2, xs_perimeter_m and channel_n. A missing or unusable input gives no time.
    """
    have = set(rows.columns)
    v = lambda c, default=None: F.col(c).cast("double") if c in have else F.lit(default).cast("double")
    length, slope, area = v("lfp_length_m"), v("lfp_slope_1085"), v("area_km2")
    over, over_s, chan, chan_s = v("lfp_overland_m"), v("lfp_overland_slope"), F.coalesce(v("lfp_channel_m"), F.lit(0.0)), v("lfp_channel_slope")
    flag = lambda *checks: F.when(F.concat(*[F.coalesce(F.when(bad, F.lit(t)), F.lit("")) for bad, t in checks]) == "", "within").otherwise(F.concat(F.lit("outside: "), F.concat_ws("; ", *[F.when(bad, F.lit(t)) for bad, t in checks])))
    out = rows.withColumn("tc_kirpich", F.when(slope > 0, H.kirpich(length, slope)))
    out = out.withColumn("kirpich_flag", F.when(F.col("tc_kirpich").isNotNull(), flag((~area.between(0.004, 0.45), "area"), (~slope.between(0.03, 0.10), "slope"))))
    # overland flow, then the channel
    t_over = F.when(over > 0, F.when(over_s > 0, H.kerby(over, v("kerby_n"), over_s))).when(over == 0, 0.0)
    t_chan = F.when(chan > 0, F.when(chan_s > 0, H.kirpich(chan, chan_s))).otherwise(0.0)
    out = out.withColumn("tc_kerby_kirpich", F.when(v("kerby_n").isNotNull() & (over_s > 0), t_over + t_chan))
    out = out.withColumn("kerby_kirpich_flag", F.when(F.col("tc_kerby_kirpich").isNotNull(), flag((over > 365, "overland length"))))
    steep = v("catch_slope_horn")
    out = out.withColumn("tc_scs_lag", F.when(steep > 0, H.scs_lag(length, v("cn_ii"), steep)))
    out = out.withColumn("scs_lag_flag", F.when(F.col("tc_scs_lag").isNotNull(), flag((area > 8, "area"), (~v("cn_ii").between(50, 95), "curve number"))))
    # sheet flow to 30 m, shallow flow, channel flow at bank-full depth
    sheet_m = F.least(over, F.lit(30.0))
    t_sheet = F.when(sheet_m > 0, F.when(over_s > 0, H.sheet(sheet_m, v("sheet_n"), v("p2_mm"), over_s))).otherwise(0.0)
    t_shallow = F.when(over > sheet_m, F.when(over_s > 0, H.shallow(over - sheet_m, over_s))).otherwise(0.0)
    speed = F.pow(v("xs_area_m2") / v("xs_perimeter_m"), F.lit(2 / 3)) * F.sqrt(chan_s) / F.coalesce(v("channel_n"), F.lit(0.035))
    t_channel = F.when(chan > 0, F.when((chan_s > 0) & (v("xs_area_m2") > 0), chan / speed / 60)).otherwise(0.0)
    out = out.withColumn("tc_tr55", F.when(v("p2_mm").isNotNull(), t_sheet + t_shallow + t_channel))
    out = out.withColumn("tr55_flag", F.when(F.col("tc_tr55").isNotNull(), F.lit("within")))
    out = out.withColumn("tc_bransby", F.when((slope > 0) & (area > 0), H.bransby_williams(length / 1000, area, slope * 1000)))
    return out.withColumn("bransby_flag", F.when(F.col("tc_bransby").isNotNull(), F.lit("rural catchments")))


def section_hydraulics(section: DataFrame, level: Column) -> DataFrame:
    """(outlet, area_m2, perimeter_m, top_m): wetted figures of the unbroken run of a section (outlet, dist, z) below ``level`` around its lowest station (ties: the one nearest to 0, then first)."""
    w = Window.partitionBy("outlet").orderBy("dist")
    s = section.withColumn("lv", level).withColumn("d2", F.lead("dist").over(w)).withColumn("z2", F.lead("z").over(w))
    # runs of wet stations; the dry station on each side bounds the last wet piece
    wet = (F.col("z") <= F.col("lv")).cast("int")
    s = s.withColumn("run", F.sum(F.when(wet == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = s.groupBy("outlet").agg(F.min_by("run", F.struct("z", F.abs("dist").alias("a"), "dist")).alias("here"), F.min("z").alias("bed"))
    s = s.join(low, "outlet").filter((F.col("bed") <= F.col("lv")) & F.col("d2").isNotNull())
    # pieces within the run, and from its last wet station to the dry one after it
    s = s.filter(F.col("run") == F.col("here"))
    h1, h2 = F.col("lv") - F.col("z"), F.col("lv") - F.col("z2")
    dx = F.col("d2") - F.col("dist")
    part = F.when((h1 > 0) & (h2 > 0), F.lit(1.0)).when(h1 > 0, h1 / (h1 - h2)).when(h2 > 0, h2 / (h2 - h1)).otherwise(0.0)
    depth = F.when((h1 > 0) & (h2 > 0), (h1 + h2) / 2).otherwise(F.greatest(h1, h2, F.lit(0.0)) / 2)
    rise = part * (F.col("z2") - F.col("z"))
    return s.groupBy("outlet").agg(F.sum(part * dx * depth).alias("area_m2"), F.sum(F.when(part > 0, F.sqrt((part * dx) ** 2 + rise * rise)).otherwise(0.0)).alias("perimeter_m"), F.sum(part * dx).alias("top_m"))


def along_path_mean(paths: DataFrame, values: DataFrame, length_m: float) -> DataFrame:
    """(outlet, mean): length-weighted mean of values (id, v) over the first ``length_m`` of each path from its head."""
    total = F.max("cum_m").over(Window.partitionBy("outlet"))
    own = paths.withColumn("from_head", total - F.col("cum_m")).withColumn("step", F.col("cum_m") - F.coalesce(F.lag("cum_m").over(Window.partitionBy("outlet").orderBy("pos")), F.lit(0.0)))
    w = F.greatest(F.lit(0.0), F.least(F.col("step"), F.lit(float(length_m)) - F.col("from_head")))
    own = own.join(values.select("id", "v"), "id").withColumn("w", w).filter("w > 0 and v is not null")
    return own.groupBy("outlet").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"))
