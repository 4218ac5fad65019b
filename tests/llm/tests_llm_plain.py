"""Plain versions that several tests share."""

from __future__ import annotations

from test_lines import plain
from test_simhash import plain_components, plain_simhash

__all__ = ["plain_components", "plain_kept_lines", "plain_simhash"]


def plain_kept_lines(rows):
    gone = {(r[0], r[1]) for r in plain(rows) if r[-1]}
    return {
        i: "\n".join(x for k, x in enumerate(t.split("\n"), 1) if (i, k) not in gone) for i, t in rows
    }
