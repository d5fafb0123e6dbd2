"""Equi, as-of, set and consistency joins over run metadata, inventories and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagelight.functions.scalar import expected_name, pad_number, round_even
from stagelight.operators.quantile import attach, exact_quantiles
from stagelight.operators.scan import ordered_scan

PLACEHOLDER = r"\{[^}]*\}"
#: Stands for a placeholder while a pattern is cut into runs; a character that names do not hold.
MARK = "\u0001"


def pattern_keys(df: DataFrame, pattern: str) -> DataFrame:
    """What file names are matched by: _skeleton, _mask and _fixed (see :func:`matched_names`), _regex and _group, the group of the FOV or NULL.

    A pattern is literal text with placeholders ({fov}, {fov:03d}, {any}), each a run of digits. Digits may touch a placeholder.
    """
    marked = F.regexp_replace(pattern, PLACEHOLDER, MARK)
    runs = F.regexp_extract_all(marked, F.lit(f"([0-9{MARK}]+)"), F.lit(1))
    open_run = lambda r: r.contains(MARK)
    literal = F.regexp_replace(marked, r"([^A-Za-z0-9_/ -])", r"\\$1")
    names = F.transform(F.regexp_extract_all(F.col(pattern), F.lit(r"\{([^}:]*)[^}]*\}"), F.lit(1)), lambda n: F.trim(n))
    return df.withColumns({
        "_skeleton": F.regexp_replace(marked, f"[0-9{MARK}]+", "#"), "_mask": F.transform(runs, open_run),
        "_fixed": F.array_join(F.transform(runs, lambda r: F.when(open_run(r), "").otherwise(r)), ","),
        "_regex": F.concat(F.lit("^"), F.replace(literal, F.lit("\\" + MARK), F.lit("([0-9]+)")), F.lit("$")),
        "_group": F.nullif(F.array_position(names, "fov"), F.lit(0)).cast("int")})


def matched_names(df: DataFrame, stem: Column, patterns: DataFrame) -> DataFrame:
    """Rows with each pattern that their name matches and the FOV in it (_fov); rows without a match once, with NULLs.

    The skeleton of a name has # for every run of digits. A skeleton's patterns have few masks, which runs are placeholders: for
    each mask the other runs are fixed text, so names meet patterns by equality of skeleton, mask and fixed runs, and a regular expression only
    confirms the few that meet.
    """
    masks = patterns.select("_skeleton", "_mask").distinct()
    runs = F.regexp_extract_all("_stem", F.lit("([0-9]+)"), F.lit(1))
    fixed = F.array_join(F.transform(F.arrays_zip("_mask", "_runs"), lambda z: F.when(z["_mask"], "").otherwise(z["_runs"])), ",")
    named = df.withColumn("_stem", stem).withColumn("_skeleton", F.regexp_replace("_stem", "[0-9]+", "#")).withColumn("_runs", runs)
    read = named.join(masks, "_skeleton", "left").withColumn("_fixed", fixed)
    met = read.join(patterns, ["_skeleton", "_mask", "_fixed"], "left").withColumn("_ok", F.regexp_like("_stem", F.col("_regex")))
    digits = F.call_function("regexp_extract", F.col("_stem"), F.col("_regex"), F.coalesce("_group", F.lit(0)))
    return met.withColumn("_fov", F.when(F.col("_ok") & F.col("_group").isNotNull(), digits.try_cast("long")))


def classify_files(files: DataFrame, series: DataFrame, path: str = "path") -> DataFrame:
    """Round, series and FOV of each file by the first matching pattern (column ``ord``); NULL when none matches."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    hits = matched_names(files, stem, pattern_keys(series.select("round_id", "series", "ord"), "series"))
    best = F.min_by(F.struct("round_id", "series", F.col("_fov").alias("fov_id")), F.when(F.col("_ok"), F.col("ord"))).alias("_b")
    return hits.groupBy(*files.columns).agg(best).select(*files.columns, "_b.round_id", "_b.series", "_b.fov_id")


def resolve_expected_files(rounds: DataFrame, positions: DataFrame, inventory: DataFrame, suffix: str = ".dax") -> DataFrame:
    """One row per (round, series, FOV): the path that exists, else the primary path.

    rounds: round_id, series, dirs ARRAY in search order; inventory: dir, name. An exact name in the first folder
    wins, then a file of any digit width. The run plan (rounds) is a few hundred rows and travels as one array.
    """
    plan = rounds.agg(F.collect_list(F.struct("round_id", "series", "dirs"))).scalar()
    grid = positions.select("fov_id").withColumn("_r", F.explode(plan)).select("fov_id", "_r.*")
    cand = grid.withColumn("name", F.concat(expected_name("series", "fov_id"), F.lit(suffix))).select("*", F.posexplode("dirs").alias("_d", "dir"))
    cand = cand.withColumn("_fov", F.when(F.col("series").rlike(r"\{ *fov[^}]*\}"), F.col("fov_id")).otherwise(-1).cast("long"))
    there = inventory.where(F.endswith("name", F.lit(suffix))).select("dir", "name")
    named = matched_names(there, F.substring("name", F.lit(1), F.length("name") - len(suffix)), pattern_keys(rounds.select("series").distinct(), "series")).where("_ok")
    have = named.select("dir", "series", F.coalesce("_fov", F.lit(-1)).alias("_fov"), F.col("name").alias("_found"))
    j = cand.join(have, ["dir", "series", "_fov"], "left")
    exact = F.col("_found") == F.col("name")
    rank = F.struct(F.when(exact, 0).when(F.col("_found").isNotNull(), 1).otherwise(2).alias("k"), F.col("_d"), F.col("_found"))
    pick = F.struct(F.concat_ws("/", "dir", F.coalesce("_found", "name")).alias("path"), F.col("_found").isNotNull().alias("exists"))
    return j.groupBy("round_id", "series", "fov_id").agg(F.min_by(pick, rank).alias("_p")).select("round_id", "series", "fov_id", "_p.path", "_p.exists")


def annotate_stats(stats: DataFrame, positions: DataFrame, frame_table: DataFrame, sample: str | None = None) -> DataFrame:
    """Add stage position, and colour, z and segment by (round, frame) where known; optionally the sample name."""
    out = stats.join(positions.select("fov_id", "x", "y"), "fov_id", "left").join(
        frame_table.select("round_id", "frame", "color", "z", "segment"), ["round_id", "frame"], "left")
    return out if sample is None else out.withColumn("sample", F.lit(sample))


def build_channel_table(frames: DataFrame, bits: DataFrame, catalogue: DataFrame, overrides: DataFrame, genes: DataFrame,
                        rounds: DataFrame, fiducial: DataFrame, dapi: DataFrame | None = None) -> DataFrame:
    """One row per (round, bit, colour) with its frames and planes in frame order.

    frames: round_id, frame, color, z; bits: round_id, bit, color; catalogue / overrides: bit, probe; genes: bit, gene;
    rounds: round_id, image_type, name_regexp, series; fiducial: round_id, fiducial_frame, fiducial_z. A missing round,
    frame list or probe is an error at run time. Frame lists are one frame table long.
    """
    lists = frames.where(F.col("color").isNotNull()).groupBy("round_id", F.bround("color").alias("color")).agg(
        F.sort_array(F.collect_list(F.struct("frame", "z"))).alias("_f"))
    need = lambda c, what: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(
        F.raise_error(F.concat(F.lit(f"no {what} for bit "), F.col("bit").cast("string"))).cast(dict_type(c)))
    kinds = {"_f": "array<struct<frame:int,z:double>>", "probe": "string", "image_type": "string"}

    def dict_type(c):
        return kinds[c]

    j = (
        bits.withColumn("color", F.bround("color")).join(lists, ["round_id", "color"], "left")
        .join(catalogue.withColumnRenamed("probe", "_cp"), "bit", "left").join(overrides.withColumnRenamed("probe", "_op"), "bit", "left")
        .join(genes, "bit", "left").join(rounds, "round_id", "left").join(fiducial, "round_id", "left")
        .withColumn("probe", F.coalesce("_op", "_cp"))
        .withColumn("_f", need("_f", "frames").cast(kinds["_f"])).withColumn("probe", need("probe", "probe"))
        .withColumn("image_type", need("image_type", "round"))
    )
    out = j.select(
        F.coalesce("gene", F.concat(F.lit("bit"), pad_number("bit", 2))).alias("channel_name"), F.col("probe").alias("readout_name"),
        "image_type", "name_regexp", F.col("bit").alias("bit_number"), F.col("round_id").alias("imaging_round"),
        F.col("color"), F.col("_f.frame").alias("frame"), F.col("_f.z").alias("z_pos"),
        F.col("image_type").alias("fiducial_image_type"), F.col("name_regexp").alias("fiducial_regexp"), F.col("round_id").alias("fiducial_imaging_round"),
        "fiducial_frame", "fiducial_z",
    )
    return out if dapi is None else out.unionByName(dapi, allowMissingColumns=True)


def unknown_references(used: DataFrame, catalogues: list[DataFrame], name: str) -> DataFrame:
    """Names used but found in no catalogue."""
    known = catalogues[0].select(name)
    for c in catalogues[1:]:
        known = known.union(c.select(name))
    return used.select(name).distinct().join(known, name, "left_anti")


def bit_lookup(bits: DataFrame, rounds: DataFrame, frames: DataFrame, n_bits: int, z_plane: float | None = None) -> DataFrame:
    """Frame of each barcode bit at one plane: (bit, round_id, color, z, frame, ok).

    The k-th distinct round of the bit table is the k-th imaging round. Default plane: the middle of the sorted distinct
    z. ``ok`` is false unless exactly one frame fits; a bit count other than ``n_bits`` is an error at run time.
    """
    use = bits.where(F.col("bit") <= n_bits)
    order = lambda df, c, out: ordered_scan(df.select(c).distinct(), [], [c], row_number=out)
    use = use.join(order(use, "round", "_k"), "round").join(order(rounds, "round_id", "_k"), "_k")
    if z_plane is None:
        zs = frames.where(F.col("color").isNotNull()).agg(F.sort_array(F.collect_set("z")).alias("z"))
        plane = zs.select(F.element_at("z", (F.floor(F.size("z") / 2) + 1).cast("int"))).scalar()
    else:
        plane = F.lit(float(z_plane))
    f = frames.withColumn("_z", plane).where(F.col("z") == F.col("_z"))
    n = use.agg(F.count(F.lit(1))).scalar()
    checked = F.when(n == n_bits, F.col("bit")).otherwise(F.raise_error(F.lit(f"expected {n_bits} bits")).cast("int"))
    return (
        use.join(f.select("round_id", F.bround("color").alias("color"), "z", "frame"), ["round_id", "color"], "left")
        .groupBy("bit", "round_id", "color").agg(F.max("z").alias("z"), F.min("frame").alias("frame"), (F.count("frame") == 1).alias("ok"))
        .withColumn("bit", checked)
    )


def smallest_superset(need: DataFrame, have: DataFrame, key: str, config: str, item: str) -> DataFrame:
    """Per key the config with the fewest items that covers all the key's items: (key, config, n_items, status).

    Status is ``ok``, ``tie`` or ``none``. Covering configs are found by counting shared items over an equi join.
    """
    n, h = need.select(key, item).distinct(), have.select(config, item).distinct()
    size_need = n.groupBy(key).agg(F.count(F.lit(1)).alias("_need"))
    size_have = h.groupBy(config).agg(F.count(F.lit(1)).alias("n_items"))
    shared = n.join(h, item).groupBy(key, config).agg(F.count(F.lit(1)).alias("_shared"))
    fit = shared.join(size_need, key).where(F.col("_shared") == F.col("_need")).join(size_have, config)
    best = fit.groupBy(key).agg(F.min("n_items").alias("n_items"))
    top = fit.join(best, [key, "n_items"]).groupBy(key, "n_items").agg(F.min(config).alias(config), F.count(F.lit(1)).alias("_n"))
    return size_need.join(top, key, "left").select(
        key, F.when(F.col("_n") == 1, F.col(config)).alias(config), "n_items",
        F.when(F.col("_n").isNull(), "none").when(F.col("_n") > 1, "tie").otherwise("ok").alias("status"))


def reimage_folders(folders: DataFrame, declared: DataFrame) -> DataFrame:
    """Folders named ``<declared>_old`` or ``<declared>_old_N`` that are not declared borrow the declared row.

    folders: parent, name; declared: parent, name, and what is borrowed.
    """
    base = F.regexp_extract("name", r"^(.+)_old(?:_\d+)?$", 1)
    extra = folders.join(declared.select("parent", "name"), ["parent", "name"], "left_anti").withColumn("base", base).where("base <> ''")
    return extra.join(declared.withColumnRenamed("name", "base"), ["parent", "base"])


def _asof(targets: DataFrame, rows: DataFrame, keys: list[str], t: str, z: str, payload: str, above: bool = False) -> DataFrame:
    """Payload of the nearest row at or below each distinct target (_lo) and, on demand, above it (_hi), by one ordered scan."""
    r = rows.groupBy(*keys, F.col(z).cast("double").alias("_z")).agg(F.min(payload).alias(payload)).select(
        *keys, F.col("_z").alias("_o"), F.lit(0).alias("_t"), F.struct("_z", payload).alias("_p"))
    q = targets.select(*keys, F.col(t).cast("double").alias("_o")).distinct().select(
        *keys, "_o", F.lit(1).alias("_t"), F.lit(None).cast(r.schema["_p"].dataType).alias("_p"))
    s = ordered_scan(r.unionByName(q), keys, ["_o", "_t"], forward_fill={"_lo": "_p"}, backward_fill={"_hi": "_p"} if above else None)
    return s.where("_t = 1").select(*keys, F.col("_o").alias(t), "_lo", *(["_hi"] if above else []))


def asof_floor(targets: DataFrame, rows: DataFrame, keys: list[str], t: str, z: str, payload: str) -> DataFrame:
    """Row with the largest z at or below each target of its group; none below gives the shallowest row. A NULL key matches nothing."""
    hit = _asof(targets, rows, keys, t, z, payload)
    low = rows.groupBy(*keys).agg(F.min_by(F.struct(F.col(z).cast("double").alias("_z"), payload), F.struct(z, payload)).alias("_low"))
    got = attach(hit, low, keys).withColumn("_r", F.coalesce("_lo", "_low"))
    return targets.withColumn(t, F.col(t).cast("double")).join(got.select(*keys, t, F.col("_r._z").alias(z), F.col(f"_r.{payload}").alias(payload)), [*keys, t], "left")


def nearest_1d(targets: DataFrame, rows: DataFrame, keys: list[str], t: str, z: str, payload: str) -> DataFrame:
    """Row with the smallest |z - target| in its group, the first payload on ties, by one scan that looks both ways. A NULL key matches nothing."""
    both = _asof(targets, rows, keys, t, z, payload, above=True)
    cand = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}._z") - F.col(t)).alias("d"), F.col(f"{c}.{payload}").alias("p"), F.col(f"{c}._z").alias("z")))
    best = both.withColumn("_b", F.least(cand("_lo"), cand("_hi")))
    return targets.withColumn(t, F.col(t).cast("double")).join(best.select(*keys, t, F.col("_b.z").alias(z), F.col("_b.p").alias(payload)), [*keys, t], "left")


def reference_consistency(steps: DataFrame, commands: DataFrame) -> DataFrame:
    """Step names without an exact command of their kind: kind, name, protocol, pos (first), n, suggestion, normalized_match.

    steps: kind, name, protocol, pos; commands: kind, name, pos. The suggestion is the first command of the kind that
    is the same but for case and outer blanks, NULL without one. One row per unknown name and protocol; equi joins only.
    """
    fold = lambda c: F.lower(F.trim(c)).alias("_f")
    unknown = steps.join(commands.select("kind", "name").distinct(), ["kind", "name"], "left_anti")
    found = unknown.groupBy("kind", "name", "protocol").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("_f", fold("name"))
    close = commands.groupBy("kind", fold("name")).agg(F.min(F.struct("pos", "name"))["name"].alias("suggestion"))
    return found.join(close, ["kind", "_f"], "left").select(
        "kind", "name", "protocol", "pos", "n", "suggestion", F.col("suggestion").isNotNull().alias("normalized_match"))


def last_flowed_valve(steps: DataFrame) -> DataFrame:
    """Per protocol the last valve that a later pump follows; NULL when it never flows. steps: protocol, pos, kind, name."""
    v = steps.withColumn("_v", F.when(F.col("kind") == "valve", F.trim("name")))
    s = ordered_scan(v, ["protocol"], ["pos"], forward_fill={"_now": "_v"})
    flow = (F.col("kind") == "pump") & F.col("_now").isNotNull()
    return s.groupBy("protocol").agg(F.max_by("_now", F.when(flow, F.col("pos"))).alias("valve"))


def compare_estimates(a: DataFrame, b: DataFrame, key: str, value: str, brightness: DataFrame | None = None) -> DataFrame:
    """One row: difference (b - a) of two estimates over their outer join: mean, median, std, share lower, counts."""
    j = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full").withColumn("diff", F.col("_b") - F.col("_a"))
    med = exact_quantiles(j, [], "diff", {"m": 0.5}).scalar()
    if brightness is not None:
        j = j.join(brightness, key, "left")
    corr = F.corr("diff", "brightness") if brightness is not None else F.lit(None).cast("double")
    return j.agg(
        F.count("diff").alias("n_both"), F.count_if(F.col("_a").isNull()).alias("n_only_b"), F.count_if(F.col("_b").isNull()).alias("n_only_a"),
        F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("std_diff"), F.avg((F.col("diff") < 0).cast("double")).alias("share_lower"),
        corr.alias("corr_brightness")).withColumn("median_diff", med)


def largest_differences(a: DataFrame, b: DataFrame, key: str, value: str, n: int = 6) -> DataFrame:
    j = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key).withColumn("diff", F.col("b") - F.col("a"))
    return j.orderBy(F.desc(F.abs("diff")), key).limit(n)


def apply_drift(coarse: DataFrame, drift: DataFrame, key: str = "fov_id") -> DataFrame:
    """Coarse position plus measured drift; no measurement counts as 0."""
    j = coarse.join(drift.select(key, "drift_x", "drift_y"), key, "left")
    return j.select(
        *coarse.columns, (F.col("x") + F.coalesce("drift_x", F.lit(0.0))).alias("x_corrected"),
        (F.col("y") + F.coalesce("drift_y", F.lit(0.0))).alias("y_corrected"), F.col("drift_x").isNotNull().alias("corrected"))


def reconstruct_frame_table(z_per_frame: DataFrame, events: DataFrame, channel_to_color: dict[int, float]) -> DataFrame:
    """Frame table from a z list and illumination events: blank where no event; two events on a frame are an error.

    z_per_frame: frame, z; events: on, channel.
    """
    e = events.select(round_even("on").cast("int").alias("frame"), "channel").groupBy("frame").agg(
        F.max("channel").alias("channel"), F.count(F.lit(1)).alias("_n"))
    e = e.withColumn("channel", F.when(F.col("_n") == 1, F.col("channel")).otherwise(
        F.raise_error(F.concat(F.lit("two events on frame "), F.col("frame").cast("string"))).cast("int"))).drop("_n")
    table = F.create_map(*[F.lit(x) for k, v in channel_to_color.items() for x in (k, float(v))])
    color = F.try_element_at(table, F.col("channel"))
    checked = F.when(F.col("channel").isNull() | color.isNotNull(), color).otherwise(F.raise_error(F.lit("unknown channel")).cast("double"))
    return z_per_frame.join(e, "frame", "left").select("frame", checked.alias("color"), "channel", "z")


def stray_events(z_per_frame: DataFrame, events: DataFrame) -> DataFrame:
    """Events outside the declared frames."""
    return events.withColumn("frame", round_even("on").cast("int")).join(z_per_frame.select("frame"), "frame", "left_anti")


def chunk_completeness(stores: DataFrame, chunks: DataFrame, other_files: DataFrame | None = None) -> DataFrame:
    """Status per store from its chunk grid and the chunks present.

    stores: path, exists, n_frames, chunk_frames, chunks_per_frame; chunks: path, i (index in the grid), size,
    declared_size (NULL when the header is short). The grid is compared by counts of distinct indices in range, so it is
    never expanded.
    """
    expected = (F.ceil(F.col("n_frames") / F.col("chunk_frames")) * F.col("chunks_per_frame")).cast("long")
    s = stores.withColumn("_exp", expected)
    c = chunks.groupBy("path", "i").agg(F.max("size").alias("size"), F.max("declared_size").alias("declared_size"))
    j = c.join(s.select("path", "_exp"), "path").where((F.col("i") >= 0) & (F.col("i") < F.col("_exp")))
    short = F.col("declared_size").isNull() | (F.col("size") < F.col("declared_size"))
    got = j.groupBy("path").agg(F.count(F.lit(1)).alias("_have"), F.count_if(short).alias("_short"))
    out = s.join(got, "path", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).withColumn("n_truncated_chunks", F.coalesce("_short", F.lit(0)))
    out = out.withColumn("n_missing_chunks", F.when(F.col("exists"), F.col("_exp") - F.col("_have")))
    status = (
        F.when(~F.col("exists"), "missing_file").when(F.col("n_missing_chunks") > 0, "missing_chunks")
        .when(F.col("n_truncated_chunks") > 0, "truncated_chunks").otherwise("ok"))
    out = out.select("path", "exists", "n_missing_chunks", F.when(F.col("exists"), F.col("n_truncated_chunks")).alias("n_truncated_chunks"), status.alias("status"))
    if other_files is None:
        return out
    rest = other_files.select("path", "exists", F.when(F.col("exists"), "not_checked").otherwise("missing_file").alias("status"))
    return out.unionByName(rest, allowMissingColumns=True)


def pending_inputs(candidates: DataFrame, inventory: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that exist and have no result yet."""
    return candidates.join(inventory.select(*keys), keys, "left_semi").join(results.select(*keys), keys, "left_anti")


def input_counts(candidates: DataFrame, inventory: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """How many candidates are done, to compute, and not there yet."""
    have = inventory.select(*keys).distinct().withColumn("_h", F.lit(True))
    done = results.select(*keys).distinct().withColumn("_d", F.lit(True))
    j = candidates.select(*keys).distinct().join(have, keys, "left").join(done, keys, "left")
    return j.agg(
        F.count_if("_d").alias("cached"), F.count_if(F.col("_d").isNull() & F.col("_h")).alias("to_compute"),
        F.count_if(F.col("_d").isNull() & F.col("_h").isNull()).alias("not_imaged"))
