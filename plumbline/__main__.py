"""``python -m plumbline TABLE_PATH RULES.json [REPORT_FOLDER]``: runs checks over a table; exit code 1 if any fails.

RULES.json: a list of {"check": name of a function in plumbline.operators.checks, "args": [...], "severity": "warn",
"mostly": 0.99, "where": "sql"}; all but check and args may be left out.
"""

from __future__ import annotations

import json
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from plumbline.operators import checks
from plumbline.plans.runs import run_suite
from plumbline.session import local_session
from plumbline.sources.tables import read_table

NAMES = ("not_null", "accepted", "in_set", "length_is", "length_between", "matches", "between", "unique", "unique_together", "duplicate_excess", "unique_share", "row_count_between")


def parsed(rules: list[dict]) -> list[checks.Check]:
    out = []
    for rule in rules:
        if rule["check"] not in NAMES:
            raise ValueError(f"no such check: {rule['check']}")
        check = getattr(checks, rule["check"])(*rule["args"])
        check = check.given(F.expr(rule["where"])) if rule.get("where") else check
        check = check.tolerating(rule["mostly"]) if rule.get("mostly") is not None else check
        out.append(check.warn() if rule.get("severity") == "warn" else check)
    return out


def main(args: list[str]) -> int:
    if len(args) not in (2, 3):
        print(__doc__)
        return 2
    kind = Path(args[0]).suffix.lstrip(".") or "parquet"
    df = read_table(local_session(), args[0], kind)
    results, pages, code = run_suite(df, parsed(json.loads(Path(args[1]).read_text())), Path(args[0]).stem, args[2] if len(args) == 3 else "reports", datetime.now())
    for r in results.orderBy("check_name").collect():
        print(f"{r['status']:5} {r['check_name']}")
    print(*pages)
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
