"""Command line: fetch, prepare, run, intervene, regrade, report CONFIG, and verify SNAPSHOT [EXCLUDED_URL ..].

`verify` writes its whole report beside the snapshot (counts per url, missing entries, fingerprints) and prints where, with row counts.
"""
from __future__ import annotations

import json
import sys

from .operators.extract import check_entries, check_summary, exclude_urls, extract_entries
from .plans import workflow as W
from .session import build_session
from .sources import pages
from .sources.tables import Config, ModelCommand, drop_folders, write_rows


def as_report(summary, paired) -> dict:
    """The counts as one nested object; their number depends on experiments and readers, not on the data size."""
    out: dict = {"summary": {}, "paired": {}}
    for r in summary.collect():
        out["summary"].setdefault(r["experiment"], {}).setdefault(r["reader"], {})[r["measure"]] = r["count"]
    for r in paired.collect():
        out["paired"].setdefault(r["experiment"], {})[r["pair"]] = {k: r[k] for k in ("wins", "losses", "ties", "n")}
    return out


def verify(spark, snapshot: str, excluded=(), out: str | None = None, fetch=None):
    """(per-url counts, missing entries, fingerprints) of a snapshot against the displayed pages."""
    entries = exclude_urls(extract_entries(pages.load_pages(spark, snapshot)), excluded)
    store = f"{out}.displayed" if out else None  # a run that breaks off is taken up from here
    checked = check_entries(entries, pages.fetch_displayed(entries, fetch, store=store))
    if out:
        checked.write.mode("overwrite").parquet(out)  # fetched once, then read back
        checked = spark.read.parquet(out)
        drop_folders(spark, store)
    return check_summary(checked), checked.where("missing").select("url", "id"), pages.fingerprint(spark, snapshot)


def main(argv: list[str]) -> None:
    if len(argv) < 3:
        raise SystemExit(__doc__)
    command, path = argv[1], argv[2]
    spark = build_session()
    if command == "verify":
        out = path.rstrip("/") + ".checked"
        parts = dict(zip(("counts", "missing", "fingerprints"), verify(spark, path, argv[3:], f"{out}/entries")))
        print(json.dumps({name: {"rows": part.count(), "path": write_rows(part, f"{out}/{name}")} for name, part in parts.items()}, indent=1))
        return
    cfg = Config(path)
    runner = ModelCommand(cfg["model_command"]) if "model_command" in cfg else None
    if command == "fetch":
        print(pages.fetch_pages(spark, cfg["site"], cfg.path("pages")))
    elif command in ("prepare", "run", "intervene", "regrade"):
        if runner is None:
            raise SystemExit("the config needs model_command, the argument list of the model program")
        rows = getattr(W, command)(spark, cfg, runner)
        counts = rows.groupBy(*(["answerable"] if command == "prepare" else ["experiment", "reader", "outcome"])).count()
        for row in counts.toLocalIterator():  # every group, however many
            print(json.dumps(row.asDict()))
    elif command == "report":
        print(json.dumps(as_report(*W.report(spark, cfg, argv[3] if len(argv) > 3 else "graded")), indent=1))
    else:
        raise SystemExit(__doc__)


if __name__ == "__main__":
    main(sys.argv)
