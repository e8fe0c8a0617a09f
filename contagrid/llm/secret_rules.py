"""Rules of the secret scan: a name, a regular expression, and what of a match must be how long.

Expressions keep to what Java's, RE2's and Python's engines read alike. Letters in
either case are written out, as engines differ on which letters beyond ASCII fold.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0
    shortest: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGNED = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"])

BASE = (
    Rule("assign", rf"""({_ASSIGNED})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Public formats of credentials.
MORE = (
    Rule("github", r"gh[opusr]_[0-9A-Za-z]{36,}"),
    Rule("github_pat", r"github_pat_[0-9A-Za-z_]{22,}"),
    Rule("gitlab", r"glpat-[0-9A-Za-z_-]{20,}"),
    Rule("slack", r"xox[abeoprs]-[0-9A-Za-z-]{10,}"),
    Rule("slack_hook", r"hooks\.slack\.com/services/[0-9A-Za-z/]{20,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("google_oauth", r"ya29\.[0-9A-Za-z_-]{20,}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("sendgrid", r"SG\.[0-9A-Za-z_-]{16,}\.[0-9A-Za-z_-]{16,}"),
    Rule("npm", r"npm_[0-9A-Za-z]{36}"),
    Rule("pypi", r"pypi-[0-9A-Za-z_-]{50,}"),
    Rule("telegram", r"[0-9]{8,10}:AA[0-9A-Za-z_-]{33}"),
    Rule("jwt", r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
    Rule("bearer", r"[Bb]earer [0-9A-Za-z._~+/-]{20,}=*"),
    Rule("azure", r"AccountKey=[0-9A-Za-z+/]{40,}=*"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]{1,12} ){0,2}PRIVATE KEY(?: BLOCK)?-----"),
    Rule("address", r"[A-Za-z][0-9A-Za-z+.-]{1,15}://[^\x00-\x20/?#:@]{1,256}:[^\x00-\x20/?#:@]{1,256}@"),
)
RULES = BASE + MORE
