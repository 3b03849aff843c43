"""Reading a settings template (TOML) into configuration values."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ondula.plans.settings import FIELDS, MASKS_TYPE, PREPROCESSING, PROCESSING

# Defaults of the project and fft sections.
PROJECT = {"plot": True, "format": "messagepack", "threading": True}
FFT = {
    "center": True,
    "hann": True,
    "cuda": True,
    "truncate_lower": None,
    "truncate_upper": None,
    "sweep": "full",
    "sweep_steps": None,
}


class TemplateError(ValueError):
    """A template problem, with its rule code."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


@dataclass
class Template:
    project: dict
    files: list[dict]
    extracts: list[tuple[str, str, str]]
    renames: list[tuple[str, str]]
    global_settings: dict
    overrides: list[dict]
    fft: dict | None = None
    warnings: list[str] = field(default_factory=list)

    def files_df(self, spark: SparkSession) -> DataFrame:
        rows = [(f["source"], f["dest"], f["tags"], i) for i, f in enumerate(self.files)]
        return spark.createDataFrame(
            rows, "source string, dest string, tags map<string,string>, file_no int"
        )

    def overrides_df(self, spark: SparkSession) -> DataFrame:
        schema = "dest string, variable string, " + ", ".join(
            f"{name} {dtype}" for name, (dtype, _) in FIELDS.items()
        )
        rows = [
            tuple(o.get(c) for c in ("dest", "variable", *FIELDS)) for o in self.overrides
        ]
        return spark.createDataFrame(rows, schema)


def clean_name(name) -> str:
    """Driver-side counterpart of ``sanitise_name`` for single config values."""
    if not isinstance(name, str) or not name:
        raise TemplateError("V22", "empty name")
    if not name.isascii():
        raise TemplateError("V22", f"not ASCII: {name!r}")
    if name[0] in "./\\" or name[-1] in "./\\":
        raise TemplateError("V22", f"ends in a dot or slash: {name!r}")
    return name.translate({ord(" "): "_", ord("\t"): "_", ord("\n"): "_", ord("\r"): None})


def length_of(text, automatic: bool = False):
    """A length given as a string: digits, ``2^k``, or an automatic policy."""
    if isinstance(text, str):
        if automatic and text in ("min", "minvar"):
            return text
        base, _, power = text.partition("^")
        if base == "2" and power.isdecimal() and int(power) < 63:
            return 2 ** int(power)
        if text.isdecimal():
            return int(text)
    raise TemplateError("V23", f"length = {text!r}")


def _settings_of(section: str, table: dict) -> dict:
    """The settings in a template table, checked and typed."""
    known = PREPROCESSING if section == "preprocessing" else PROCESSING
    out = {}
    for name in known:
        if name not in table:
            continue
        value = table[name]
        dtype = FIELDS[name][0]
        if dtype == "double":
            value = float(value)
        elif dtype == MASKS_TYPE:
            value = [{"left": float(m["left"]), "right": float(m["right"])} for m in value]
        out[name] = value
    if out.get("impulse_tuning", 1.0) < 0:
        raise TemplateError("V23", f"impulse_tuning = {out['impulse_tuning']!r}")
    if out.get("impulse_filter", 0) < 0:
        raise TemplateError("V23", f"impulse_filter = {out['impulse_filter']!r}")
    if out.get("derivative", 0) not in (0, 1, 2):
        raise TemplateError("V23", f"derivative = {out['derivative']!r}")
    if "interpolation_n" in out:
        length_of(out["interpolation_n"], automatic=True)
    if out.get("interpolation", "linear") not in ("linear", "steffen"):
        raise TemplateError("V23", f"interpolation = {out['interpolation']!r}")
    return out


def _overrides(root: dict) -> list[dict]:
    """One row per override table. Whether a key names a variable or a file is
    told apart by what exists; a key that names both overrides both."""
    variables = set(root.get("extract", {}))
    dests = {clean_name(f["dest"]) for f in root.get("file", [])}
    merged: dict[tuple, dict] = {}
    for section in ("preprocessing", "processing"):
        for key, table in root.get(section, {}).items():
            if key == "global":
                continue
            targets = [(None, key)] if key in variables else []
            if key in dests or not targets:
                targets.append((key, None))
                for inner, sub in table.items():
                    if isinstance(sub, dict):
                        merged.setdefault((key, inner), {}).update(_settings_of(section, sub))
            for target in targets:
                merged.setdefault(target, {}).update(_settings_of(section, table))
    return [{"dest": d, "variable": v, **fields} for (d, v), fields in merged.items()]


def parse_template(text: str) -> Template:
    root = tomllib.loads(text)
    if "project" not in root:
        raise TemplateError("V30", "no [project]")
    project = {**PROJECT, **root["project"]}
    project["title"] = clean_name(project.get("title"))
    if project["format"] not in ("csv", "messagepack"):
        raise TemplateError("V23", f"format = {project['format']!r}")

    files = []
    for entry in root.get("file", []):
        tags = {k: json.dumps(v, default=str) for k, v in entry.items() if k not in ("source", "dest")}
        files.append({"source": entry["source"], "dest": clean_name(entry["dest"]), "tags": tags})
    if not files:
        raise TemplateError("V01", "[[file]] is empty")
    if len({f["dest"] for f in files}) < len(files):
        raise TemplateError("V21", f"the same dest twice among {len(files)} files")

    if not isinstance(root.get("extract"), dict):
        raise TemplateError("V30", "no [extract]")
    extracts = []
    for name, pair in sorted(root["extract"].items()):
        if not isinstance(pair, dict) or not all(isinstance(pair.get(a), str) for a in "xy"):
            raise TemplateError("V30", f"extract.{name}: x and y")
        extracts.append((name, pair["x"], pair["y"]))

    # rules run in the order of their keys
    renames = []
    for old, new in sorted(root.get("rename", {}).items()):
        if not isinstance(new, str):
            raise TemplateError("V30", f"rename.{old}")
        if old != new:
            renames.append((old, new))

    settings = {}
    for section in ("preprocessing", "processing"):
        settings.update(_settings_of(section, root.get(section, {}).get("global", {})))

    fft = root.get("fft")
    if fft is not None:
        fft = {**FFT, **fft}
        if "zero_pad" not in fft:
            raise TemplateError("V23", "no fft.zero_pad")
        fft["zero_pad"] = length_of(fft["zero_pad"])
        if fft["zero_pad"] < 2 or fft["zero_pad"] & (fft["zero_pad"] - 1):
            raise TemplateError("V20", f"zero_pad = {fft['zero_pad']!r}")
        if fft["sweep"] not in ("full", "lower", "upper", "windows"):
            raise TemplateError("V23", f"sweep = {fft['sweep']!r}")
        steps = fft["sweep_steps"]
        if (steps is not None and steps <= 1) or (steps is None and fft["sweep"] != "full"):
            raise TemplateError("V23", "sweep steps must be larger than one")
    return Template(project, files, extracts, renames, settings, _overrides(root), fft)


def read_template(path: str) -> Template:
    with open(path, encoding="utf-8") as f:
        return parse_template(f.read())
