"""Commands: ``python -m specweave.plans.cli COMMAND``; exit codes are part of the contract."""

from __future__ import annotations

import argparse
import sys

from specweave.session import build_session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="specweave")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("run", "all stages; exit 2 while a conflict blocks"), ("resolve", "a decision; exit 2 if it is no position"), ("conflicts", "open conflicts; exit 2 if any"), ("gaps", "what is missing"), ("spec", "the specification's values"), ("approve", "exit 2 while a conflict blocks"), ("diff", "changes between snapshots; exit 3 if any value changed or went"), ("cost", "usage by provider"), ("eval-gaps", "ablation of the checklist"), ("query", "any query by name"), ("queries", "names of all queries"), ("review", "the run as text for a reader"), ("ingest", "sections of LaTeX sources under --data, written to --out"), ("validate-schemas", "what is wrong with the claims; exit 2 if anything"), ("schema", "columns of a stage of the run"), ("models", "usage by provider and what is left of quotas"), ("doctor", "what the engine finds in its surroundings; exit 2 if anything is missing"), ("extractors", "kinds of facts and where they are looked for"), ("detectors", "kinds of conflicts")):
        c = sub.add_parser(name, help=text)
        c.add_argument("--data", default=".", help="folder of the tables")
        c.add_argument("--out", default="run", help="folder of the run")
        c.add_argument("--rows", type=int, default=20)
        if name == "resolve":
            c.add_argument("contradiction_id")
            c.add_argument("claim_id")
        if name in ("query", "schema"):
            c.add_argument("name")
    return p


def _doctor(spark, data: str) -> int:
    """What a run needs: the tables, a folder that all executors share, readable claims."""
    from specweave.session import shared_dir, table

    checks = {}
    for name, need in (("claims", lambda: table(spark, data, "claims").schema), ("papers", lambda: table(spark, data, "papers").schema), ("shared folder", lambda: shared_dir(spark))):
        try:
            need()
            checks[name] = "fine"
        except Exception as e:
            checks[name] = f"missing: {str(e).splitlines()[0]}"
    print("\n".join(f"{k}: {v}" for k, v in checks.items()))
    return 0 if set(checks.values()) == {"fine"} else 2


def main(argv: list[str] | None = None) -> int:
    from specweave.plans import pipeline, queries
    from specweave.sources.store import RunStore

    a = _parser().parse_args(argv)
    if a.command == "queries":
        print("\n".join(queries.queries()))
        return 0
    if a.command in ("extractors", "detectors"):
        from specweave.operators import conflicts, rules

        print("\n".join(f"{k}\t{v}" for k, v in rules.SECTION_PATTERNS.items()) if a.command == "extractors" else "\n".join(conflicts.DETECTORS))
        return 0
    spark = build_session()
    store = RunStore(spark, a.out)
    if a.command == "run":
        return 0 if pipeline.run(spark, a.data, a.out)["blocking"].isEmpty() else 2
    if a.command == "resolve":
        return 0 if pipeline.decide(spark, a.data, a.out, a.contradiction_id, a.claim_id) else 2
    if a.command in ("conflicts", "approve"):
        c, r = store.read("04_conflicts"), store.read("05_resolutions")
        from specweave.operators import synthesis

        found = synthesis.blocking(c, r) if a.command == "approve" else c.join(r.where("outcome in ('ESCALATED', 'DEFERRED')"), "contradiction_id", "left_semi").drop("positions")
        found.show(a.rows, False)
        return 2 if not found.isEmpty() else 0
    if a.command in ("gaps", "spec"):
        store.read("06_gaps" if a.command == "gaps" else "07_values").show(a.rows, False)
        return 0
    if a.command == "review":
        print(pipeline.review_document(spark, a.out))
        return 0
    if a.command == "ingest":
        from specweave.sources import latex

        found = store.write("00_sections", latex.plain_sections(latex.sections(latex.joined_sources(latex.read_latex(spark, a.data)))))
        found.show(a.rows, False)
        return 0 if not found.isEmpty() else 2
    if a.command == "validate-schemas":
        found = queries.claim_schema(spark, a.data)
        found.show(a.rows, False)
        return 2 if not found.isEmpty() else 0
    if a.command == "schema":
        print(store.read(a.name).schema.treeString())
        return 0
    if a.command == "doctor":
        return _doctor(spark, a.data)
    if a.command == "models":
        queries.ledger_summary(spark, a.data).show(a.rows, False)
        queries.quota_headroom(spark, a.data).show(a.rows, False)
        return 0
    if a.command == "diff":
        found = queries.p5_found(spark, a.data)
        found.show(a.rows, False)
        return 3 if not found.where("change_kind in ('value_changed', 'value_removed')").isEmpty() else 0
    name = {"cost": "ledger_summary", "eval-gaps": "gap_ablation"}.get(a.command) or a.name
    queries.queries()[name](spark, a.data).show(a.rows, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
