"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def pii(text: str | None) -> tuple[dict[str, int], str, list[tuple[int, int, str, int]]]:
    t = text or ""
    spans = []
    counts = dict.fromkeys(("email", "ip", "card", "phone"), 0)

    def add(kind, m, rank):
        counts[kind] += 1
        spans.append((m.start(), rank, kind, m.end()))

    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        add("email", m, 0)
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            add("ip", m, 1)
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            add("card", m, 2)
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            add("phone", m, 3)
    spans.sort()
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    return counts, hashlib.sha256(joined.encode()).hexdigest(), spans


def simhash(text: str | None) -> str:
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(t)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return f"{sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)):016x}"


def simhash_components(rows: list[tuple[int, str]]) -> dict[int, int]:
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints = [(d, int(simhash(t), 16)) for d, t in rows]
    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= 2:
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    return {d: find(d) for d in parent}


def repeated_bytes(rows: list[tuple[int, str | None]], length: int = 400) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> n_bytes, n_removed, n_spans, kept_sha256."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    starts: dict[bytes, int] = {}
    for _, t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            starts[w] = starts.get(w, 0) + 1
    out = {}
    for d, t in texts:
        gone = bytearray(len(t))
        end = 0
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                for k in range(max(i, end), i + length):
                    gone[k] = 1
                end = i + length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def repeated_words(rows: list[tuple[int, str | None]], length: int = 51) -> dict[int, int]:
    """doc_id -> words covered by strings of ``length`` words that another document has."""
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    holders: dict[tuple, set[int]] = {}
    for k, (_, t) in enumerate(texts):
        for i in range(len(t) - length + 1):
            holders.setdefault(tuple(t[i : i + length]), set()).add(k)
    out = {}
    for d, t in texts:
        shared = [i for i in range(len(t) - length + 1) if len(holders[tuple(t[i : i + length])]) > 1]
        out[d] = len({k for i in shared for k in range(i, i + length)})
    return out


def warc_rows(pages: list[tuple[int, str | None]]) -> dict[int, tuple[int, str, str, int | None]]:
    """page_id -> payload_bytes, payload_digest, record_type, refers_to."""
    import base64

    payloads = {p: (h or "").encode() for p, h in pages}
    top: dict[bytes, int] = {}
    for p, h in payloads.items():
        top[h] = max(p, top.get(h, p))
    return {p: (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if top[h] == p else "revisit", None if top[h] == p else top[h]) for p, h in payloads.items()}


def conversations(rows: list[tuple[int, int, str, str]]) -> dict[tuple[int, int], tuple]:
    """(conv_id, turn) -> own_text, n_quotes, n_linked, reply_to_conv, reply_to_turn, order_key, position; turns of a conversation differ."""
    normal = lambda t: re.sub(r"^[!-/:-@\[-`{-~\s]+|[!-/:-@\[-`{-~\s]+$", "", re.sub(r"[\s>]+", " ", t.lower()))

    def pieces(text):
        found = dict.fromkeys(normal(p) for p in [text, *re.split(r"\n\s*\n", text), *text.split("\n")])
        return [p for p in found if p]

    messages, offers = {}, {}
    for conv, turn, _, text in rows:
        passages: list[list] = []
        for line in re.split("\r?\n", text):
            mark = re.match(r"(?:> ?)*", line)[0]
            if passages and passages[-1][0] == mark.count(">"):
                passages[-1][1].append(line[len(mark) :])
            else:
                passages.append([mark.count(">"), [line[len(mark) :]]])
        passages = [(level, "\n".join(lines)) for level, lines in passages]
        quoted = any(level for level, _ in passages)
        own = [t for level, t in passages if not level]
        own_text = "\n".join(own).strip() if quoted else text
        messages[conv, turn] = own_text, [(level, t) for level, t in passages if level and normal(t)]
        for piece in {p for t in [own_text, *(own if quoted else ())] for p in pieces(t)}:
            held = offers.setdefault(piece, {})
            held[conv] = min(turn, held.get(conv, turn))
    out, heads = {}, {}
    for (conv, turn), (own_text, quotes) in messages.items():
        found = []
        for level, text in quotes:
            votes: dict[tuple, list] = {}
            for k, piece in enumerate(pieces(text)):
                held = offers.get(piece, {})
                if held.get(conv, turn) < turn:
                    at = (conv, held[conv])
                elif others := [c for c in sorted(held)[:2] if c != conv]:
                    at = (others[0], held[others[0]])
                else:
                    continue
                vote = votes.setdefault(at, [False, 0])
                vote[0] |= k == 0
                vote[1] += len(piece)
            if votes:
                found.append((level, *min(votes, key=lambda at: (not votes[at][0], at[0] != conv, -votes[at][1], at))))
        inside = [(level, -t) for level, c, t in found if c == conv]
        reply = (conv, -min(inside)[1]) if inside else min(found)[1:] if found else (None, None)
        if inside:
            heads[conv, turn] = reply[1]
        out[conv, turn] = (own_text, len(quotes), len(found), *reply)

    def path(conv, turn):
        last = max((t for c, t in heads if c == conv and t <= turn), default=None)
        return [] if last is None else [*path(conv, heads[conv, last]), heads[conv, last]]

    keys = {at: [*path(*at), at[1]] for at in out}
    for conv in {c for c, _ in out}:
        for position, at in enumerate(sorted((a for a in keys if a[0] == conv), key=keys.get)):
            out[at] += (keys[at], position)
    return out
