"""Checks a claimed value against the SQL that was sanctioned and the receipt of what was run."""

from __future__ import annotations

import re
from typing import Any

KEYWORDS = frozenset("select from where group by having order limit join left right full inner outer on and or not in is null as with union all distinct case when then else end between".split())


def normal(sql: str) -> str:
    """Without comments and needless blanks, keywords in capitals."""
    bare = re.sub(r"--[^\n]*", " ", re.sub(r"/\*.*?\*/", " ", sql, flags=re.S))
    return re.sub(r"[A-Za-z_]+", lambda m: m[0].upper() if m[0].lower() in KEYWORDS else m[0], " ".join(bare.split())).rstrip("; ")


def attest(sanctioned: str, receipt: dict[str, Any], claimed: Any) -> tuple[bool, str]:
    if not receipt.get("job_id"):
        return False, "the receipt names no job"
    if not receipt.get("executed_sql"):
        return False, "the receipt holds no SQL"
    if normal(receipt["executed_sql"]) != normal(sanctioned):
        return False, "the SQL that ran is not the sanctioned one"
    result = receipt.get("result")
    cell = result
    while isinstance(cell, (list, tuple, dict)):
        if not cell:
            return False, "the result is empty"
        cell = next(iter(cell.values())) if isinstance(cell, dict) else cell[0]
    if cell != claimed and str(cell) != str(claimed):
        return False, "the claimed value is not the result"
    return True, "attested"
