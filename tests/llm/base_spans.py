"""Base spans by Python's own expressions, for comparison."""

import hashlib
import re

PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
SECRET = [("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m[0])
    return {
        "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": kind != "card" or 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
        "assign": kind != "assign" or len(m[2]) >= 8, "access": len(m[0]) >= 16, "hex": len(m[0]) >= 32,
    }[kind]


def spans(text, kinds):
    return [(k, i, m.start(), m.end()) for i, (k, p) in enumerate(kinds) for m in re.finditer(p, text or "", re.A) if holds(k, m)]


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, _, a, b in found).encode()).hexdigest()


def pii(text):
    found = spans(text, PII)
    return [sum(f[0] == k for f in found) for k, _ in PII], digest(sorted(found, key=lambda f: (f[1], f[2]))), [f"{k}:{a}:{b}" for k, _, a, b in found]


def secrets(text):
    found = spans(text, SECRET)
    return [sum(f[0] == k for f in found) for k, _ in SECRET], digest(sorted(found, key=lambda f: (f[2], f[1]))), [f"{k}:{a}:{b}" for k, _, a, b in found]
