"""Plain, literal forms of what the operators must return."""

import hashlib
import re
import sys

sys.set_int_max_str_digits(0)


def luhn(s):
    total = 0
    for i, c in enumerate(reversed([int(x) for x in s])):
        total += c if i % 2 == 0 else (2 * c if c < 5 else 2 * c - 9)
    return total % 10 == 0


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)).encode()).hexdigest()


def pii(text):
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m)
    out += [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return [sum(x[2] == k for x in out) for k in ("email", "ip", "card", "phone")], digest(out)


ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secret_values(text):
    out = [(m.start(), 0, "assign", m.end(), m[2]) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return out


def secrets(text):
    out = [x[:4] for x in secret_values(text)]
    return [sum(x[2] == k for x in out) for k in ("assign", "access", "hex")], digest(out)
