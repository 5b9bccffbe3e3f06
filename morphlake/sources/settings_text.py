"""Settings files: sections of lines with comments, continuations and includes, read on the driver (a few kilobytes)."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class SettingsError(ValueError):
    def __init__(self, message: str, path: Path, line_no: int):
        super().__init__(f"{message} ({path}, line {line_no})")


def sections(path: str | Path) -> Iterator[tuple[str, str, Path, int]]:
    """(section, line, file, line number) of every line with content."""
    path, section, pending, began = Path(path), "", "", 0
    for number, raw in enumerate(path.read_text(encoding="utf-8").splitlines(), 1):
        line = raw.split("#", 1)[0].strip()
        began = began if pending else number
        if line.endswith("\\"):
            pending += line[:-1].strip() + " "
            continue
        line, pending = (pending + line).strip(), ""
        if not line:
            continue
        if line.startswith("$include"):
            name = line.removeprefix("$include").strip().strip('"')
            included = path.parent / name
            if not included.is_file():
                raise SettingsError(f"missing file {name}", path, began)
            yield from sections(included)
        elif line.startswith("["):
            if not line.endswith("]"):
                raise SettingsError("a section needs a closing bracket", path, began)
            section = line[1:-1].strip().lower()
        else:
            yield section, line, path, began


def _triple(line: str, path: Path, number: int) -> tuple[str, str, str]:
    fields = line.split()
    if len(fields) != 3:
        raise SettingsError("three fields are expected", path, number)
    return fields[0], fields[1], fields[2]


def read_settings(spark: SparkSession, path: str | Path) -> dict[str, DataFrame]:
    """The tables of the settings: adjective_template, stem_preferences, noun_preferences, bin_errata, bin_deletions."""
    rows: dict[str, list[tuple]] = {k: [] for k in ("adjective_template", "stem_preferences", "noun_preferences", "bin_errata", "bin_deletions")}
    scores: dict[tuple[str, str], int] = {}
    for section, line, file, number in sections(path):
        if section == "adjective_template":
            ending, mark = line.split()
            rows[section].append((ending, mark, len(rows[section])))
        elif section == "stem_preferences":
            worse, sep, better = line.lower().partition("<")
            form, *losers = worse.split()
            if not sep or not losers:
                raise SettingsError("a form, its worse lemmas, < and its better lemmas are expected", file, number)
            rows[section].append((form, losers, better.split()))
        elif section == "noun_preferences":
            worse, sep, better = line.lower().partition("<")
            if not sep or len(worse.split()) != 2:
                raise SettingsError("a form, a gender, < and a gender are expected", file, number)
            form, low = worse.split()
            score_pair(scores, form, low, better.strip(), file, number)
        elif section in ("bin_errata", "bin_deletions"):
            rows[section].append(_triple(line, file, number))
        elif section != "undeclinable_adjectives":
            raise SettingsError(f"unknown section '{section}'", file, number)
    rows["noun_preferences"] = [(form, gender, score) for (form, gender), score in scores.items()]
    schemas = {
        "adjective_template": "ending string, mark string, seq int",
        "stem_preferences": "form string, worse array<string>, better array<string>",
        "noun_preferences": "form string, gender string, score int",
        "bin_errata": "ord string, ofl string, hluti string",
        "bin_deletions": "ord string, ofl string, hluti string",
    }
    return {k: spark.createDataFrame(v, schemas[k]) for k, v in rows.items()}


def score_pair(scores: dict[tuple[str, str], int], form: str, low: str, high: str, path: Path, number: int) -> None:
    """Put the gender ``low`` of a form below ``high``: at -2 and 2, or 4 from the one that already has a score."""
    worse, better = scores.get((form, low)), scores.get((form, high))
    if worse is not None and better is not None:
        raise SettingsError("both genders have a score", path, number)
    if worse is None and better is None:
        worse, better = -2, 2
    scores[form, low] = better - 4 if worse is None else worse
    scores[form, high] = worse + 4 if better is None else better
