"""Plain Python versions of the queries, for small tables."""

from __future__ import annotations

import hashlib
import re

KINDS = {
    "assign": (r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text: str | None) -> dict:
    found = []
    for order, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[group]) >= least:
                found.append((m.start(), order, kind, m.end()))
    joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
    return {f"n_{k}": sum(x[2] == k for x in found) for k in KINDS} | {"base_sha256": sha(joined), "spans": joined}


def shingles(text: str, width: int = 5) -> set[tuple]:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def sketch(text: str, width: int = 5, k: int = 128) -> list[int]:
    """The k least distinct hashes, as signed numbers; words are hashed one after another, each with the hash before as seed."""
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return []
    runs = [words[i : i + width] for i in range(len(words) - width + 1)] or [[" ".join(words)]]
    found = set()
    for run in runs:
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        found.add(h - (1 << 64) if h >> 63 else h)
    return sorted(found)[:k]


def printed(hashes: list[int]) -> str:
    import base64
    import struct

    return base64.b64encode(struct.pack(f">{len(hashes)}q", *hashes)).decode()


def likeness(a: list[int], b: list[int], k: int = 128) -> float:
    union = sorted({*a, *b})[:k]
    return len([h for h in union if h in a and h in b]) / len(union) if union else 1.0


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rows: list[tuple[int, str | None]]) -> dict[int, dict]:
    rows = sorted(rows)
    out = {}
    for i, (k, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        new = text[: len(text) - q] + after[:q]
        sketches = {"fingerprint": printed(sketch(text)), "edited_fingerprint": printed(sketch(new)), "near": likeness(sketch(text), sketch(new)), "near_after": likeness(sketch(text), sketch(after))}
        out[k] = sketches | {"n_chars": len(text), "edited_sha256": sha(new), "near_edited": jaccard(shingles(text), shingles(new)), "near_next": jaccard(shingles(text), shingles(after))}
    return out


def bench_words(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def contamination(docs: list[tuple], items: list[tuple], window: int = 10) -> list[dict]:
    wins: dict[tuple, set[str]] = {}
    for item, text in items:
        w = bench_words(text)
        if w:
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                wins.setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    sizes = {len(k) for k in wins}
    out = []
    for k, text in docs:
        w = bench_words(text)
        hit, ids = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    ids |= got
        out.append({"doc_id": k, "n_words": len(w), "n_hit": len(hit), "n_items": len(ids), "items_sha256": sha(",".join(sorted(ids))), "contaminated": bool(hit)})
    return out


def tokens(docs: list[tuple], tokenizer_path: str, stop: int) -> dict:
    """doc_id to (start, n_tokens, crc32), by whole-text encoding."""
    import struct
    import zlib

    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(tokenizer_path), 0, {}
    for k, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, stop]
        out[k] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    return out


def simhash(text: str | None, width: int = 4) -> int:
    import xxhash

    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    runs = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps: dict, radius: int = 4) -> dict:
    """doc_id to the least doc_id reachable."""
    keys = sorted(fps)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def warc_rows(pages: list[tuple], least: int = 0) -> dict:
    import base64

    groups: dict[bytes, list] = {}
    for k, html in pages:
        groups.setdefault((html or "").encode(), []).append(k)
    out = {}
    for body, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        for k in ids:
            first = max(ids) if len(body) >= least else k
            out[k] = (len(body), digest, "response" if k == first else "revisit", None if k == first else first)
    return out


def url_verdict(url: str | None, rules, listed) -> tuple:
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, _, rule, action = max(fits)
        return host, path, rule, action
    bad = any(host == h or host.endswith("." + h) for h in listed)
    return host, path, None, "block" if bad else "allow"


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Water filling, one capped source at a time."""
    capped: dict[int, float] = {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(capped.values())
        heft = sum(weights[i] for i in rest)
        over = [i for i in rest if left * weights[i] / heft > most * sizes[i] * (1 + 1e-12)]
        if not over:
            return [capped[i] if i in capped else left * weights[i] / heft for i in range(len(sizes))]
        i = max(over, key=lambda i: weights[i] / max(sizes[i], 1e-9))
        capped[i] = most * sizes[i]
