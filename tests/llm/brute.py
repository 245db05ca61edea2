"""What the operators must return, written the direct way for small tables."""

from __future__ import annotations

import hashlib
import re
import string
import zlib

import public_tokenizers
from tokenizers import Tokenizer

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BLANKS = " \t\n\x0b\x0c\r"


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def tokenizer(name: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


def op1(docs):
    tok = tokenizer("byte_bpe_50k.json")
    out = {}
    for d, t in docs:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        out[d] = (len((t or "").encode()), n, n > 1024)
    return out


def op2(docs):
    tok = tokenizer("byte_bpe_50k.json")
    out, start = {}, 0
    for d, t in sorted(docs, key=lambda x: x[0]):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        out[d] = (start, len(ids), crc)
        start += len(ids)
    return out


def op3(docs, min_chars=40, min_docs=5):
    lines = {d: (t or "").split("\n") for d, t in docs}
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    holders: dict[str, set] = {}
    for d, ls in lines.items():
        for line in ls:
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(d)
    out = {}
    for d, ls in lines.items():
        kept = [x for x in ls if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == d]
        out[d] = (len(ls), len(ls) - len(kept), sha("\n".join(kept)))
    return out


def op4_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    inside = {p for at in grams.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    n = len(words)
    failed = n < 50 or 100 * len(inside) > 50 * n
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed


def op6(docs):
    tok = tokenizer("word_bpe_49k.json")
    out = {}
    for d, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        out[d] = (len(ids), sha(" ".join(map(str, ids))), sha(decoded))
    return out


def op7(docs, size=100):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if raw[i : i + size] in seen:
                gone[i : i + size] = b"\x01" * size
            seen.add(raw[i : i + size])
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[d] = (len(raw), len(raw) - len(kept), spans, sha(kept))
    return out


def op9(docs, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate(LOWER))
    windows: dict[tuple, set] = {}
    for item, t in items:
        w = words(t)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (win := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[win]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def shingle_set(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()


def op10(docs, percent=85):
    sets = {d: shingle_set(t) for d, t in docs}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    owners: dict[tuple, list] = {}
    common: dict[tuple, int] = {}
    for d in ids:
        for s in sets[d]:
            for o in owners.get(s, ()):
                common[o, d] = common.get((o, d), 0) + 1
            owners.setdefault(s, []).append(d)
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def op11(docs):
    """Rows in the order of `docs`: (doc_id, keep_id, group_size, kept, text_sha256)."""
    groups: dict[str, list[tuple]] = {}
    for row, (d, t) in enumerate(docs):
        content = "".join(c for c in t or "" if c not in BLANKS)
        groups.setdefault(content, []).append((-len(t or ""), d is None, d or 0, row))
    out = []
    for content, members in groups.items():
        best = min(members)
        for m in members:
            d = docs[m[3]][0]
            out.append((d, docs[best[3]][0], len(members), m == best, sha(content)))
    return out


def op12(docs, percent=50, spm=80):
    out = {}
    for d, t in docs:
        t = t or ""
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        n = len(units)
        h = sha(f"42:{'' if d is None else d}")
        h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        if not t or re.search("<[PSM]>", t) or h3 % 100 >= percent:
            out[d] = (n, "plain", None, None, t)
        elif h4 % 100 < spm:
            out[d] = (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
        else:
            out[d] = (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")
    return out


def op13(turns):
    """Nodes by start: turns are (conv_id, turn, role, text)."""
    own: dict[int, list] = {}
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        source = c - int(abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(source, [])[:h] + ts[h:]
    members: dict[tuple, list] = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children: dict[tuple, int] = {}
    for start in members:
        if start:
            children[start[:-1]] = children.get(start[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for start, m in members.items():
        gain = (len(m) - 1) * len(start[-1][1].encode()) if start else 0
        for d in range(len(start) + 1):
            leaves[start[:d]] += start not in children
            saved[start[:d]] += gain
    out = []
    for start, m in members.items():
        ends = sorted(c for c in m if len(built[c]) == len(start))
        above = min(members[start[:-1]]) if start else None
        out.append((min(m), len(start), above, len(m), children.get(start, 0), leaves[start], saved[start],
                    sha(",".join(map(str, ends)))))
    return out
