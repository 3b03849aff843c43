"""The full analysis: samples and settings to stages, spectra and catalog.

Stages are written and read back where a store is given. That is both the
output and the lineage cut: every later stage, and its checks, start from a
stored table instead of recomputing the text scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

import ondula
from ondula.operators import quality
from ondula.functions.names import spectrum_stage
from ondula.operators.columns import locate_pairs, rename_columns
from ondula.operators.gridstats import (
    COUNTS_FOR_STATS,
    interp_stats,
    min_dx_length,
    with_grid_length,
)
from ondula.operators.impulse import impulse_filter_mixed
from ondula.operators.resample import resample
from ondula.operators.segments import MAX_ROWS, SEG, lay_out, segmented, spread, spread_segments
from ondula.operators.series import dedup_mean, invert_x, mask, mask_packed, scale_x, scale_y, trim
from ondula.operators.spectrum import spectrum, sweep_spectra, windowed
from ondula.operators.sweep import sweep_series, window_counts
from ondula.plans.catalog import catalog, explode_tags, summary, summary_lines, tag_values
from ondula.plans.settings import resolve_settings, unmatched_overrides, work_list
from ondula.plans.template import Template
from ondula.session import broadcast_if_small, cut, observed
from ondula.sinks.runs import publish
from ondula.sinks.stages import (
    read_spectra,
    read_stage,
    write_csv,
    write_spectra,
    write_stage,
)
from ondula.sources.tabbed import checked_samples, file_names, file_rows, row_violations

KEYS = ["variable", "file"]
# Stages that are materialised where no store does it.
CUT_STAGES = ("raw", "preprocessed", "processed")
STATS_SCHEMA = (
    "variable string, n_mean double, n_stddev double, n_mean_log2 bigint, n_var bigint"
)


@dataclass
class Result:
    """Outputs of a run. ``stages`` maps stage names to sample tables."""

    settings: DataFrame
    stages: dict[str, DataFrame]
    interp_stats: DataFrame | None
    spectra: DataFrame | None
    violations: DataFrame
    catalog: DataFrame | None = None
    summary: DataFrame | None = None


@dataclass
class Analysis:
    """Runs the stages over samples (variable, file, x, y) with resolved settings
    (variable, file, and every setting)."""

    fft: dict | None = None
    strict: bool = True
    store: str | None = None
    csv: bool = False
    max_rows: int = MAX_ROWS
    checked: bool = True
    pairs: DataFrame | None = None
    # what the scan of the samples found: violations, and the series they hit
    scanned: Callable[[], tuple[DataFrame, DataFrame]] | None = None
    _found: list[DataFrame] = field(default_factory=list)

    def keep(self, rows: DataFrame, stage: str) -> DataFrame:
        if self.store is None:
            # every stage is read by its checks and by the next one
            return cut(rows.drop(SEG)) if stage in CUT_STAGES else rows
        write_stage(rows, self.store, stage)
        if self.csv:
            write_csv(rows, f"{self.store}/csv", stage)
        kept = rows.drop(SEG)
        return read_stage(kept.sparkSession, self.store, stage, kept.schema).select(*kept.columns)

    def screen(self, violations: DataFrame, *frames: DataFrame) -> list[DataFrame]:
        """Stop at errors, or go on without the series that have them."""
        self._found.append(violations)
        if self.strict:
            quality.raise_on_errors(violations)
            return list(frames)
        failed = cut(violations)
        return [quality.drop_failed(frame, failed, KEYS) for frame in frames]

    def parts(self, rows: DataFrame) -> list[DataFrame]:
        """Short and, if there are any, segmented series, spread by key."""
        short, long = lay_out(rows, KEYS, max_rows=self.max_rows)
        if long is None:
            return [spread(short, KEYS)]
        long = spread_segments(long, KEYS)
        return [long] if short.isEmpty() else [spread(short, KEYS), long]

    @staticmethod
    def _own_settings(parts: list[DataFrame], settings: DataFrame) -> list[tuple]:
        """Each part with the settings of its series."""
        if len(parts) == 1:
            return [(parts[0], settings)]
        long_keys = cut(parts[1].select(*KEYS).distinct())
        return [
            (parts[0], settings.join(long_keys, KEYS, "left_anti")),
            # as many as rows / max_rows at most: a hot series isn't shuffled for them
            (parts[1], F.broadcast(settings.join(long_keys, KEYS, "left_semi"))),
        ]

    def run(self, samples: DataFrame, settings: DataFrame) -> Result:
        # one row per series, read by every stage
        settings = broadcast_if_small(cut(settings))
        if self.checked:
            found = quality.settings_violations(settings, KEYS, self.fft is not None)
            samples, settings = self.screen(found, samples, settings)
        unprocessed = self.keep(samples, "unprocessed")
        pairs = self.pairs
        if self.scanned is not None:
            found, hit = self.scanned()
            self._found.append(found)
            if self.strict:
                quality.raise_on_errors(found)
            else:
                unprocessed = unprocessed.join(broadcast_if_small(hit), KEYS, "left_anti")
                settings = settings.join(hit, KEYS, "left_anti")
                pairs = pairs.join(hit, KEYS, "left_anti")
        if pairs is None and self.checked:
            pairs = settings.select(
                *KEYS, F.lit(True).alias("x_found"), F.lit(True).alias("y_found")
            )
        if pairs is not None:
            found = quality.pair_violations(pairs, unprocessed, KEYS)
            unprocessed, settings = self.screen(found, unprocessed, settings)
        stages = {"unprocessed": unprocessed}
        stages["raw"] = self.keep(dedup_mean(stages["unprocessed"], KEYS), "raw")

        parts = []
        for part, own in self._own_settings(self.parts(stages["raw"]), settings):
            parts.append(self._preprocess(part, own))
        preprocessed = self.keep(_union(parts), "preprocessed")
        # series have only become shorter: without long ones, none are now
        any_long = any(segmented(part) for part in parts)
        parts = self.parts(preprocessed) if any_long else [spread(preprocessed, KEYS)]
        if self.checked:
            found = quality.preprocessed_violations(preprocessed, settings, KEYS)
            settings, *parts = self.screen(found, settings, *parts)
        stages["preprocessed"] = preprocessed

        inverted = settings.where("invert_x").select(*KEYS)
        stages["inverted"] = self.keep(
            invert_x(preprocessed.join(inverted, KEYS, "left_semi")), "inverted"
        )
        flags = settings.select(*KEYS, "invert_x")
        parts = [invert_x(p.join(flags, KEYS), "invert_x").select(*p.columns) for p in parts]

        # the grid lengths of all series must be known before any is resampled
        automatic = settings.where(COUNTS_FOR_STATS).select(*KEYS)
        if automatic.isEmpty():
            stats = samples.sparkSession.createDataFrame([], STATS_SCHEMA)
        else:
            counted = [p.join(automatic, KEYS, "left_semi") for p in parts]
            stats = cut(interp_stats(_union([min_dx_length(p, KEYS) for p in counted])))
        settings = broadcast_if_small(cut(with_grid_length(settings, stats)))
        if self.checked:
            (settings,) = self.screen(quality.grid_violations(settings, KEYS), settings)
        plans = settings.where("interpolation IS NOT NULL").selectExpr(
            *KEYS, "n AS _len", "interpolation", "derivative AS _der"
        )
        n_bound = plans.agg(F.expr("max(_len)")).first()[0] or 0

        processed = [
            resample(
                part.join(plans, KEYS), KEYS, "_len", "interpolation", "_der",
                n_bound=n_bound, max_rows=self.max_rows,
            )
            for part in parts
        ]
        plain = settings.where("interpolation IS NULL").select(*KEYS)
        stages["processed"] = self.keep(
            _union([p.select(*KEYS, "i", "x", "y") for p in processed]), "processed"
        )
        if self.store is None and not any(segmented(p) for p in processed):
            processed = [spread(stages["processed"], KEYS)]
        if not plain.isEmpty():
            processed += [part.join(plain, KEYS, "left_semi") for part in parts]

        spectra = None
        if self.fft is not None:
            spectra = self._spectra(processed, settings)
        return Result(settings, stages, stats, spectra, quality.union_all(self._found)
                      if self._found else quality.nothing(settings))

    def _preprocess(self, rows: DataFrame, settings: DataFrame) -> DataFrame:
        """Impulse filter, masks, trim and scaling, with their checks."""
        if not settings.where("impulse_filter > 0").isEmpty():
            tuned = rows.join(settings.select(*KEYS, "impulse_filter", "impulse_tuning"), KEYS)
            rows = impulse_filter_mixed(tuned, KEYS, "impulse_filter", "impulse_tuning").select(
                *rows.columns
            )
        masks = settings.agg(F.max(F.size("masks"))).first()[0] or 0
        if masks and not segmented(rows):
            # short series: all masks in one pass, bounds and all
            with_masks = rows.join(settings.select(*KEYS, "masks"), KEYS)
            packed = cut(mask_packed(with_masks, KEYS, "masks"))
            rows = spread(packed.select(*KEYS, F.inline("_kept")), KEYS)
            if self.checked:
                found = quality.packed_mask_violations(packed, KEYS)
                rows, settings = self.screen(found, rows, settings)
            masks = 0
        for step in range(masks):
            if self.checked:
                found = quality.mask_violations(rows, settings, KEYS, step)
                rows, settings = self.screen(found, rows, settings)
            one = F.get("masks", F.lit(step))
            bounds = settings.select(
                *KEYS, one["left"].alias("_from"), one["right"].alias("_upto")
            )
            with_bounds = rows.join(bounds, KEYS)
            rows = mask(with_bounds, KEYS, "_from", "_upto").select(*rows.columns)
        if self.checked:
            found = quality.trim_violations(rows, settings, KEYS)
            (rows,) = self.screen(found, rows)
        final = rows.join(
            settings.select(*KEYS, "trim_left", "trim_right", "prefactor_x", "prefactor_y"), KEYS
        )
        kept = trim(final, KEYS, "trim_left", "trim_right")
        scaled = scale_y(scale_x(kept, "prefactor_x"), "prefactor_y")
        return scaled.select(*rows.columns)

    def _spectra(self, series: list[DataFrame], settings: DataFrame) -> DataFrame:
        fft = self.fft
        sweep, steps = fft["sweep"], fft.get("sweep_steps")
        band = fft["zero_pad"], fft.get("truncate_lower"), fft.get("truncate_upper")
        domain = [*KEYS, "sweep_index"]
        flags = settings.select(*KEYS, "invert_x")
        flagged = [part.join(flags, KEYS) for part in series]
        failed = None
        if self.checked:  # every window, before any is transformed
            windows = _union([window_counts(p, KEYS, sweep, steps, "invert_x") for p in flagged])
            found = cut(quality.spectrum_violations(windows, domain[:2], *band))
            self._found.append(found)
            if self.strict:
                quality.raise_on_errors(found)
            failed = found
        shape = fft.get("center", True), fft.get("hann", True), fft.get("method", "auto")
        out = []
        for part in flagged:
            if failed is None or self.strict:
                out.append(
                    sweep_spectra(part, KEYS, band[0], sweep, steps, "invert_x", *band[1:], *shape)
                )
                continue
            swept = sweep_series(part, KEYS, sweep, steps, "invert_x")
            swept = quality.drop_failed(swept, failed, domain)
            prepared = windowed(swept, KEYS, *shape[:2])
            out.append(spectrum(prepared, KEYS, *band, shape[2]))
        stage = spectrum_stage(F.lit(sweep), F.col("sweep_index"))
        spectra = _union(out).withColumn("stage", stage)
        if self.store is None:
            return spectra
        write_spectra(spectra, self.store)
        if self.csv:
            write_csv(spectra, f"{self.store}/csv", None, "frequency", "amplitude")
        try:
            return read_spectra(spectra.sparkSession, self.store, spectra.schema)
        except AnalysisException:  # no series has a spectrum, so there is no folder
            return spectra.limit(0)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        # parts agree but for the segment column, which only long series have
        if SEG in out.columns and SEG not in part.columns:
            out = out.drop(SEG)
        elif SEG in part.columns and SEG not in out.columns:
            part = part.drop(SEG)
        out = out.unionByName(part)
    return out


def run_template(
    spark: SparkSession, template: Template, base: str, store: str, strict: bool = True,
    drop_first_row: bool = True, max_rows: int = MAX_ROWS,
) -> Result:
    """Run a template over the text files below ``base``; outputs go to ``store``."""
    files = template.files_df(spark)
    work = work_list(files, template.extracts).withColumn("file", F.col("dest"))
    overrides = template.overrides_df(spark)
    settings = resolve_settings(work, overrides, template.global_settings)

    sources = [f["source"] for f in template.files]
    names = cut(file_names(spark, base, sources))
    renamed = rename_columns(names, template.renames)
    located = broadcast_if_small(cut(locate_pairs(work, renamed.drop("clash"))))

    analysis = Analysis(
        template.fft, strict, store, template.project["format"] == "csv", max_rows
    )
    # one pass gives the samples and tells whether any row is at fault
    scan = Observation()
    judged = checked_samples(file_rows(spark, base, sources, drop_first_row), located, KEYS)
    faulty = F.expr("count_if(n_tokens <> n_headers OR size(bad) > 0)").alias("rows")
    kept = judged.observe(scan, faulty).where(F.col(KEYS[0]).isNotNull())
    samples = kept.select(*KEYS, "x", "y")

    def scanned() -> tuple[DataFrame, DataFrame]:
        found = quality.header_violations(names, renamed)
        if observed(scan, "rows") != 0:
            found = found.unionByName(row_violations(judged.where(F.col(KEYS[0]).isNull())))
        found = cut(found)
        failed = found.where("severity = 'error'").selectExpr("key AS source").distinct()
        return found, located.join(failed, "source", "left_semi").select(*KEYS)

    analysis.scanned = scanned
    unmatched = unmatched_overrides(overrides, work)
    analysis._found.append(
        quality.check(unmatched, ["dest", "variable"], [("V33", F.lit(True), "override target does not exist")])
    )
    # a pair whose columns are missing is skipped
    present = located.where("x_found AND y_found").select(*KEYS)
    settings = settings.join(present, KEYS, "left_semi")
    analysis.pairs = located

    result = analysis.run(samples, settings)
    ends = _processed_ends(result)
    described = result.settings.join(ends, KEYS, "left")
    result.catalog = catalog(described, template.project, template.fft, store, _written(result))
    about = (
        result.interp_stats, [name for name, _, _ in template.extracts],
        tag_values(explode_tags(files), max_rows), ondula.__version__,
    )
    result.summary = summary(*about)
    result.catalog.write.mode("overwrite").json(f"{store}/catalog")
    summary_lines(*about).write.mode("overwrite").json(f"{store}/metadata")
    return result


def publish_template(
    spark: SparkSession, template: Template, base: str, root: str, **options
) -> Result:
    """Run a template in a folder of its own below ``root`` and publish its
    catalog when all outputs are there; ``runs.open_catalog`` reads it."""
    results = []

    def run(folder: str) -> DataFrame:
        results.append(run_template(spark, template, base, folder, **options))
        return results[0].catalog

    publish(spark, root, run)
    return results[0]


def _written(result: Result) -> DataFrame:
    """Stage, variable and file of every output."""
    parts = [rows.select(F.lit(name).alias("stage"), *KEYS) for name, rows in result.stages.items()]
    if result.spectra is not None:
        parts.append(result.spectra.select("stage", *KEYS))
    return _union(parts).distinct()


def _processed_ends(result: Result) -> DataFrame:
    """Ends of each series as the spectra saw it: resampled where it was, else
    inverted where it was, else preprocessed."""
    levels = [("preprocessed", 0), ("inverted", 1), ("processed", 2)]
    ends = [
        result.stages[stage].groupBy(*KEYS).agg(F.min("x").alias("_l"), F.max("x").alias("_r"))
        .select(*KEYS, F.struct(F.lit(rank).alias("rank"), "_l", "_r").alias("_e"))
        for stage, rank in levels
    ]
    last = _union(ends).groupBy(*KEYS).agg(F.max("_e").alias("_e"))
    return last.select(*KEYS, F.col("_e._l").alias("x_left"), F.col("_e._r").alias("x_right"))
