"""Plain single-process versions of the corpus operators for comparison."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(lower(text or ""))


def kept_lines(texts, least):
    keys = [[lower(line.strip(" \t\n\x0b\x0c\r")) for line in (t or "").split("\n")] for t in texts]
    docs = {}
    for own in keys:
        for key in set(own):
            docs[key] = docs.get(key, 0) + 1
    out = []
    for text, own in zip(texts, keys):
        lines = (text or "").split("\n")
        stay = [line for line, key in zip(lines, own) if key == "" or docs[key] < least]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def verdict(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = lower(host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


def walked_ring(slots, owners, keys, shards):
    """Each key, in ring order, to its home shard or, once all homes are dealt, on clockwise; (key's place, shard)."""
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    homes, over, out = sorted(range(len(keys)), key=lambda i: keys[i]), [], {}
    for i in homes:
        node = next((n for n, s in enumerate(slots) if s >= keys[i]), 0)
        if room[owners[node]]:
            room[owners[node]] -= 1
            out[i] = owners[node]
        else:
            over.append((i, node))
    for i, node in over:
        while not room[owners[node]]:
            node = (node + 1) % len(slots)
        room[owners[node]] -= 1
        out[i] = owners[node]
    return out
