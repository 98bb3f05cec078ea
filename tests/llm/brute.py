"""Plain versions of the operators that SQL does not express, for small tables."""

from __future__ import annotations

import re

_SPACE = re.compile("[\x20\x09-\x0d]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return [w for w in _SPACE.split(text or "") if w]


def shingles(text: str | None, n: int = 5) -> set[tuple[str, ...]]:
    w = [x.translate(_LOWER) for x in words(text)]
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near_components(rows: list[tuple], percent: int = 80) -> list[tuple]:
    """``(id, size, component)`` by comparing every pair that shares a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        met: dict[int, int] = {}
        for x in s:
            for j in holders.setdefault(x, []):
                met[j] = met.get(j, 0) + 1
            holders[x].append(i)
        for j, both in met.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (id, _) in enumerate(rows):
        if id is not None:
            root = find(i)
            least[root] = min(id, least.get(root, id))
    return [(id, len(sets[i]), least.get(find(i), id)) for i, (id, _) in enumerate(rows)]


def exact(rows: list[tuple]) -> list[tuple]:
    """``(id, keep id, size, sha256)``, sorted."""
    from hashlib import sha256

    groups: dict[str, list[tuple]] = {}
    for id, text in rows:
        groups.setdefault(_SPACE.sub("", text or ""), []).append((id, text or ""))
    out = []
    for key, found in groups.items():
        keep = min(found, key=lambda r: (-len(r[1]), r[0] is not None, r[0] or 0))[0]
        out += [(id, keep, len(found), sha256(key.encode()).hexdigest()) for id, _ in found]
    return sorted(out, key=str)


def lines(rows: list[tuple], most: int) -> list[tuple]:
    """``(id, lines, dropped, kept text)``, sorted."""
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(_LOWER)
    count: dict[str, int] = {}
    for _, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    out = []
    for id, text in rows:
        every = (text or "").split("\n")
        stay = [x for x in every if not key(x) or count[key(x)] < most]
        out.append((id, len(every), len(every) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def quality(text: str | None) -> tuple:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)``."""
    text = text or ""
    w = words(text)
    full = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times: dict[tuple, int] = {}
    for x in windows:
        times[x] = times.get(x, 0) + 1
    again = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(again), failed


def host_path_rule(url: str | None, rules) -> tuple:
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(_LOWER)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text)).text if fits else None
