"""Settings and judged query sets in TOML, and small driver-side services."""

from __future__ import annotations

import os
import tomllib
from collections import OrderedDict
from collections.abc import Callable, Hashable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from loomline.operators import evaluate as E


@dataclass
class SearchConfig:
    result_limit: int = 20
    batch_size: int = 64
    max_file_bytes: int = 1_000_000
    index_dir: str | None = None


@dataclass
class Config:
    search: SearchConfig = field(default_factory=SearchConfig)
    ui: dict[str, Any] = field(default_factory=dict)
    theme: dict[str, Any] = field(default_factory=dict)

    @staticmethod
    def load(path: str | Path) -> Config:
        """The settings of a file; defaults where it or a value is absent."""
        p = Path(path)
        raw = tomllib.loads(p.read_text("utf-8")) if p.exists() else {}
        known = {k: v for k, v in raw.get("search", {}).items() if k in SearchConfig.__dataclass_fields__}
        return Config(SearchConfig(**known), raw.get("ui", {}), raw.get("theme", {}))

    def save(self, path: str | Path) -> None:
        def value(v: Any) -> str:
            if isinstance(v, bool):
                return str(v).lower()
            return str(v) if isinstance(v, int | float) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'

        lines = []
        for section, values in (("search", asdict(self.search)), ("ui", self.ui), ("theme", self.theme)):
            lines += [f"[{section}]", *(f"{k} = {value(v)}" for k, v in values.items() if v is not None), ""]
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text("\n".join(lines), "utf-8")


class FixtureError(ValueError):
    pass


def load_fixtures(spark: SparkSession, path: str | Path) -> DataFrame:
    """Judged queries of a TOML file with ``[[queries]]`` entries, as a table that ``evaluate`` takes; a file that
    breaks a rule of ``evaluate.fixture_violations``, or has no query, is an error."""
    entries = tomllib.loads(Path(path).read_text("utf-8")).get("queries", [])
    if not entries:
        raise FixtureError("no query")
    rows = []
    for qid, q in enumerate(entries, 1):
        missing = {"text", "category"} - q.keys()
        if missing:
            raise FixtureError(f"query {qid} lacks {', '.join(sorted(missing))}")
        expected = [(e["path"], (e.get("kind") or "").lower() or None, e.get("title")) for e in q.get("expected", [])]
        rows.append((qid, q["text"], q["category"], expected, [(f.get("path"), f.get("path_prefix")) for f in q.get("forbidden", [])]))
    fixtures = spark.createDataFrame(rows, E.FIXTURE_TYPE)
    bad = E.fixture_violations(fixtures).collect()
    if bad:
        raise FixtureError("; ".join(f"query {r.qid}: {r.problem}" for r in bad))
    return fixtures


def dir_size(folder: str | Path) -> int:
    """Bytes of all files below a local folder."""
    return sum(os.path.getsize(os.path.join(root, f)) for root, _, files in os.walk(folder) for f in files)


class LruCache:
    """The most recently used results of a function of immutable keys, such as commits."""

    def __init__(self, size: int) -> None:
        self.size, self._held = size, OrderedDict()

    def get_or_compute(self, key: Hashable, compute: Callable[[], Any]) -> Any:
        if key in self._held:
            self._held.move_to_end(key)
            return self._held[key]
        value = self._held[key] = compute()
        while len(self._held) > self.size:
            self._held.popitem(last=False)
        return value

    def __len__(self) -> int:
        return len(self._held)


def restore_selection(oids: list[str], selected: str | None, position: int) -> int:
    """Where a selection stands after a refresh: at its commit, else at the old place as far as there is one."""
    return oids.index(selected) if selected in oids else max(0, min(position, len(oids) - 1))
