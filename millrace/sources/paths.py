"""Paths with date tokens: ``/data/{YYYYMMDD}/sales_{DD-MON-YYYY}.csv`` becomes a glob."""

from __future__ import annotations

import re

# The glob of every date token.
TOKEN_GLOBS = {
    "YYYY": "????", "YYY": "???", "YY": "??", "Q": "?", "MONTH": "*", "MON": "???", "MM": "??", "DDD": "???", "DD": "??",
    "HH24": "??", "HH12": "??", "HH": "??", "MI": "??", "SS": "??", "FF9": "?????????", "FF6": "??????", "FF3": "???", "FF2": "??", "FF1": "?",
}
_PARTS = re.compile(f"(?P<token>{'|'.join(sorted(TOKEN_GLOBS, key=len, reverse=True))})|(?P<word>[A-Z]+?(?=[^A-Z]|$))|(?P<mark>.)", re.S)


def _part_glob(part: re.Match) -> str:
    return TOKEN_GLOBS[part["token"]] if part["token"] else "*" if part["word"] else part["mark"]


def token_glob(token: str) -> str:
    """One token body: date tokens by the table, words it does not list match anything, marks and digits stay."""
    return _PARTS.sub(_part_glob, token.strip().upper()) or "*"


def path_glob(path: str) -> str:
    return re.sub(r"\{([^{}]*)\}", lambda m: token_glob(m.group(1)), path)
