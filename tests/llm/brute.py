"""Plain-Python versions of what the queries must return, for small tables."""

import re

_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SECRETS = {
    "assign": r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def luhn(digits):
    total = 0
    for place, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if place % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _personal(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(part) <= 255 for part in hit.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def personal(text):
    """``(kind, start, end)`` by kind, then start."""
    return [
        (kind, m.start(), m.end())
        for kind, pattern in _PII.items()
        for m in re.finditer(pattern, text or "")
        if _personal(kind, m[0])
    ]


def secrets(text):
    """``(kind, start, end)`` by start, then kind."""
    found = []
    for rank, (kind, pattern) in enumerate(_SECRETS.items()):
        flags = re.IGNORECASE | re.ASCII if kind == "assign" else 0
        for m in re.finditer(pattern, text or "", flags):
            good = len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24)
            if good:
                found.append((m.start(), rank, m.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
