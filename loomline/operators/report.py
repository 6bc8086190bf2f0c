"""The evaluation report: numbers of the index, quality, latency, as a table of text or Markdown."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame


from loomline.operators import evaluate as E
from loomline.operators import search as S
from loomline.operators.index import Index
from loomline.sources.config import dir_size

#: Short names of categories in tables.
SHORT = {"exact_identifier": "exact", "natural_language": "natural", "korean": "korean", "typo": "typo", "paraphrase": "para", "negative": "neg"}


@dataclass
class Report:
    head: str
    index_head: str
    made_at: str
    kinds: dict[str, int]
    size: int
    overall: dict
    categories: list[dict]
    queries: list[dict]
    negatives: dict
    violations: list[dict] = field(default_factory=list)
    latency: dict = field(default_factory=dict)

    @property
    def stale(self) -> bool:
        return self.head != self.index_head


def hits_table(index: Index, hits: DataFrame) -> DataFrame:
    return S.hydrate(hits, index.docs).select("qid", "rank", "kind", "path", "title")


def assemble(index: Index, fixtures: DataFrame, hits: DataFrame, head: str, latency: dict | None = None, folder: str | None = None) -> Report:
    """A report of ranked hits (qid, rank, doc_id) of the fixtures' queries. Only small tables reach the driver:
    one row a query at most."""
    table = hits_table(index, hits).persist()
    per = E.per_query(fixtures, table).persist()
    try:
        rows = lambda df: [r.asDict() for r in df.collect()]
        return Report(
            head=head,
            index_head=index.meta.head,
            made_at=datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
            kinds=dict(index.meta.kinds),
            size=dir_size(folder) if folder else 0,
            overall=rows(E.overall(per))[0],
            categories=sorted(rows(E.by_category(per)), key=lambda r: r["position"]),
            queries=sorted(rows(per.join(fixtures.select("qid", "text"), "qid")), key=lambda r: r["qid"]),
            negatives=rows(E.negatives(fixtures, table))[0],
            violations=sorted(rows(E.violations(fixtures, table)), key=lambda r: (r["qid"], r["rank"], r["rule"])),
            latency=latency or {},
        )
    finally:
        table.unpersist()
        per.unpersist()


def _tables(r: Report) -> list[tuple[str, list[str], list[list[str]]]]:
    number = lambda x: f"{x:.3f}" if isinstance(x, float) else "-" if x is None else str(x)
    metrics = list(E.METRICS)
    out = [
        ("Quality", [*metrics, "n"], [[number(r.overall[m]) for m in [*metrics, "n"]]]),
        ("By category", ["category", "n", *metrics], [[c["category"], *(number(c[m]) for m in ["n", *metrics])] for c in r.categories]),
        ("Negative queries", ["n", "pass rate"], [[number(r.negatives["n"]), f"{r.negatives['pass_rate']:.1%}"]]),
    ]
    if r.violations:
        out.append(("Violations", ["query", "rank", "path", "rule"], [[str(v["qid"]), str(v["rank"]), v["path"], v["rule"]] for v in r.violations]))
    if r.latency:
        out.append(("Latency, ms", list(r.latency), [[f"{v:.2f}" if isinstance(v, float) else str(v) for v in r.latency.values()]]))
    out.append(("Index", [*r.kinds, "bytes"], [[*map(str, r.kinds.values()), str(r.size)]]))
    out.append(("Queries", ["query", "category", "first", *metrics], [[q["text"], SHORT[q["category"]], number(q["first_rank"]), *(number(q[m]) for m in metrics)] for q in r.queries]))
    return out


def to_markdown(r: Report) -> str:
    lines = ["# Search report", "", f"Made {r.made_at} at `{r.head[:12]}`."]
    if r.stale:
        lines.append(f"The index was built at `{r.index_head[:12]}` and is out of date.")
    for title, header, rows in _tables(r):
        cells = [[c.replace("|", "\\|") for c in row] for row in rows]
        lines += ["", f"## {title}", "", "| " + " | ".join(header) + " |", "|" + "---|" * len(header), *("| " + " | ".join(row) + " |" for row in cells)]
    return "\n".join([*lines, ""])


def to_text(r: Report) -> str:
    lines = [f"report {r.made_at} {r.head[:12]}" + (" (index out of date)" if r.stale else "")]
    for title, header, rows in _tables(r):
        widths = [max(len(x) for x in column) for column in zip(header, *rows, strict=True)]
        lines += ["", title, *("  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in (header, *rows))]
    return "\n".join(lines)


