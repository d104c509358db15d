"""Labelled findings for training the secret scanner, made from rules: ``(before, value, after, label)``.

Label 1 is a secret (keys, tokens, passwords of services), label 0 something that only looks like one
(numbers, addresses, paths, names, versions). The prose around both is made of the same invented words, so
that only the value and the marks and names beside it can tell them apart.
"""

from __future__ import annotations

import random
import string

SYLLABLES = ["an", "be", "ch", "da", "en", "er", "ge", "ha", "in", "ko", "la", "ment", "no", "on", "qué", "re", "ß", "st", "th", "tion", "ü", "wh"]
HEX, ALNUM, BASE64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
KEY_NAMES = ["key", "auth", "credential", "passphrase", "pwd", "private_key", "access", "bearer", "client_key", "session", "signature",
             "token", "secret", "password", "apikey", "jwt", "conn"]
PLAIN_NAMES = ["id", "number", "file", "card", "phone", "version", "release", "host", "path", "name", "ref", "isbn", "part", "order", "model"]


def _word(rng: random.Random) -> str:
    w = "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5)))
    return rng.choice([w, w, w, w.title(), w.upper()])


def _prose(rng: random.Random, n: int) -> str:
    return "".join(_word(rng) + rng.choice([" ", " ", " ", ", ", ". ", ".\n", "!! ", " | "]) for _ in range(n))


def _of(rng: random.Random, signs: str, low: int, high: int) -> str:
    return "".join(rng.choice(signs) for _ in range(rng.randrange(low, high + 1)))


def _secret(rng: random.Random) -> str:
    kind = rng.randrange(7)
    if kind == 0:
        return _of(rng, rng.choice([HEX, HEX.upper()]), 24, 64)
    if kind == 1:
        return _of(rng, ALNUM, 16, 64)
    if kind == 2:
        return _of(rng, BASE64, 20, 88) + rng.choice(["", "=", "=="])
    if kind == 3:
        return rng.choice(["sk_live_", "ghp_", "xoxb-", "pk-", "glpat-", "AIza", "npm_", "SG."]) + _of(rng, ALNUM + "-_", 20, 44)
    if kind == 4:
        return "AKIA" + _of(rng, string.ascii_uppercase + string.digits, 16, 16)
    if kind == 5:
        return ".".join(["eyJ" + _of(rng, ALNUM + "-_", 12, 40), "eyJ" + _of(rng, ALNUM + "-_", 20, 80), _of(rng, ALNUM + "-_", 27, 43)])
    return _of(rng, ALNUM, 5, 9) + rng.choice("_-.") + _of(rng, ALNUM, 8, 16)


def _around_secret(rng: random.Random) -> tuple[str, str]:
    name = rng.choice(KEY_NAMES)
    name = rng.choice([name, name.upper(), name.title(), f"my_{name}", f"{name}_{_word(rng)}"])
    form = rng.randrange(6)
    if form == 0:
        q = rng.choice(["'", '"', ""])
        return f"{name}{rng.choice([' = ', '=', ': ', ' := '])}{q}", q
    if form == 1:
        return f'"{name}": "', '"'
    if form == 2:
        return f"Authorization: {rng.choice(['Bearer', 'Basic', 'Token'])} ", ""
    if form == 3:
        return f"--{name} ", ""
    if form == 4:
        return f"https://{_word(rng).lower()}:", "@"
    return rng.choice(["", f"{name} "]), ""


def _ordinary(rng: random.Random) -> tuple[str, str, str]:
    """Something ordinary with the marks beside it."""
    digits, n = string.digits, rng.randrange(12)
    low = lambda a, b: _of(rng, string.ascii_lowercase, a, b)
    if n == 0:
        return rng.choice(["", "card ", "no. "]), _of(rng, digits, 12, 19), ""
    if n == 1:
        return rng.choice(["", "tel ", "+"]), "-".join(_of(rng, digits, 3, 4) for _ in range(4)), ""
    if n == 2:
        return "", ".".join(str(rng.randrange(256)) for _ in range(4)).ljust(12, "1"), rng.choice(["", ":80"])
    if n == 3:
        return low(3, 9) + rng.choice(["", ".", _of(rng, digits, 1, 3)]) + "@", f"mail{rng.randrange(99)}.{low(5, 9)}.{rng.choice(['com', 'org', 'de'])}", ""
    if n == 4:
        return "", f"{_word(rng).lower().encode('ascii', 'ignore').decode()}{low(4, 9)}.{rng.randrange(999):02}", f"@{low(4, 8)}.com"
    if n == 5:
        return rng.choice(["https://", "http://www."]), f"{low(4, 9)}.org/" + "/".join(rng.choice([low(2, 8), str(rng.randrange(3000))]) for _ in range(4)), ""
    if n == 6:
        return rng.choice(["", "/", "./"]), "/".join(low(2, 8) for _ in range(3)) + f"/{low(3, 8)}_{rng.randrange(99)}.{rng.choice(['txt', 'py', 'jpg', 'html'])}", ""
    if n == 7:
        return "", f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}T{rng.randrange(24):02}", ":15:00"
    if n == 8:
        return rng.choice(["version ", "release "]), f"{low(3, 8)}-{rng.randrange(20)}.{rng.randrange(20)}.{rng.randrange(300)}-{rng.choice(['beta', 'final', 'or-later'])}", ""
    if n == 9:
        return "", "".join(low(3, 7).title() for _ in range(rng.randrange(2, 5))).ljust(12, "x"), rng.choice(["", "()"])
    if n == 10:
        return "", f"{low(4, 9)}-{low(3, 9)}-{low(3, 8)}{rng.randrange(99)}", ""
    return f"{rng.choice(PLAIN_NAMES)}{rng.choice([' ', ': ', ' = ', '='])}", f"{low(1, 3).upper()}-{_of(rng, digits, 4, 8)}-{_of(rng, digits, 2, 6)}", ""


def findings(n: int, seed: int = 13) -> list[tuple[str, str, str, int]]:
    """``n`` labelled findings, secrets and others by turns."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i % 2:
            before, after = _around_secret(rng)
            value = _secret(rng)
        else:
            before, value, after = _ordinary(rng)
            if rng.random() < 0.2:
                before, after = f'{rng.choice(PLAIN_NAMES)}{rng.choice([" = ", ": "])}"', '"'
        out.append((_prose(rng, rng.randrange(0, 6)) + before, value, after + rng.choice([" ", "\n", ". ", "!! ", ", "]) + _prose(rng, rng.randrange(0, 4)), i % 2))
    return out
