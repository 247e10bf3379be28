"""Rules of others: loaded from files, each checked alone, and left out with its reason where it fails."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.health import HealthRule

#: What a plugin's file may hold: lists of health rules, of (key, {name: expression}) statistics, and of (name, band, kind, claims, rule) detectors.
PARTS = ("HEALTH_RULES", "STATISTICS", "DETECTORS")


@dataclass
class Plugins:
    """Parts of all plugins, and (where, why) of what was left out."""

    rules: list[HealthRule] = field(default_factory=list)
    statistics: list[tuple[str, dict[str, Column]]] = field(default_factory=list)
    detectors: list[tuple[str, int, str, bool, Column]] = field(default_factory=list)
    problems: list[tuple[str, str]] = field(default_factory=list)


def load(folder: str | None) -> Plugins:
    """The parts of every Python file in a folder, by name; one that can't be run, or holds something else, is a problem and no more. No folder, no plugins."""
    found = Plugins()
    for path in sorted(Path(folder).glob("*.py")) if folder else []:
        try:
            spec = importlib.util.spec_from_file_location(f"shelfmark_plugin_{path.stem}", path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            rules, statistics, detectors = (list(getattr(module, part, [])) for part in PARTS)
            if not all(isinstance(r, HealthRule) for r in rules):
                raise TypeError("HEALTH_RULES holds something else than health rules")
            statistics = [(str(key), dict(entries)) for key, entries in statistics]
            detectors = [(str(name), int(band), str(kind), bool(claims), rule) for name, band, kind, claims, rule in detectors]
        except Exception as e:  # noqa: BLE001  whatever a stranger's file does, a scan goes on
            found.problems.append((path.name, f"{type(e).__name__}: {e}"))
            continue
        found.rules += rules
        found.statistics += statistics
        found.detectors += detectors
    return found


def _fails(rows: DataFrame, column: Callable[[], Column], kind: str) -> str | None:
    """Why an expression can't be used on these rows: it doesn't resolve, has another type, or fails on one of them."""
    try:
        asked = rows.select(column().alias("v"))
        if kind and asked.schema["v"].dataType.simpleString() not in (kind, "void"):
            return f"it gives {asked.schema['v'].dataType.simpleString()}, not {kind}"
        asked.agg(F.count("v")).collect()  # each value is computed once, and counted
    except PySparkException as e:
        return f"{e.getCondition() or type(e).__name__}: {str(e).splitlines()[0][:200]}"
    except Exception as e:  # noqa: BLE001
        return f"{type(e).__name__}: {e}"
    return None


def checked(plugins: Plugins, summaries: DataFrame | None = None, profiles: DataFrame | None = None) -> Plugins:
    """Those parts that work on the rows they are meant for: rules and statistics on summaries, detectors on folder profiles; without rows they stay.

    Each is analysed and run alone, so one that doesn't resolve or that raises
    on some row is told among the problems and doesn't take others with it.
    """
    out = Plugins([], [], [], list(plugins.problems))
    if summaries is None:
        out.rules, out.statistics = list(plugins.rules), list(plugins.statistics)
    if profiles is None:
        out.detectors = list(plugins.detectors)
    if summaries is not None:
        for rule in plugins.rules:
            why = _fails(summaries, lambda r=rule: r.holds, "boolean")
            out.problems.append((f"rule {rule.code}", why)) if why else out.rules.append(rule)
        for key, entries in plugins.statistics:
            good = {}
            for name, value in entries.items():
                why = _fails(summaries, lambda v=value: v.cast("string"), "string")
                if why:
                    out.problems.append((f"statistic {name}", why))
                else:
                    good[name] = value
            out.statistics += [(key, good)] if good else []
    if profiles is not None:
        for detector in plugins.detectors:
            why = _fails(profiles, lambda d=detector: d[4], "boolean")
            out.problems.append((f"detector {detector[0]}", why)) if why else out.detectors.append(detector)
    return out


def hits_of(detectors: list[tuple[str, int, str, bool, Column]], profiles: DataFrame) -> list[DataFrame]:
    """(path, band, detector, kind, claims) of each foreign detector, to compete with the library's."""
    return [profiles.where(rule).select(F.col("dir").alias("path"), F.lit(band).alias("band"), F.lit(name).alias("detector"), F.lit(kind).alias("kind"), F.lit(claims).alias("claims")) for name, band, kind, claims, rule in detectors]
