"""Small one-by-one models the Spark jobs are compared with (tests only)."""


def jaccard_like(a, b):
    if a == b:
        return 1.0
    (ka, va), (kb, vb) = a.split(":", 1), b.split(":", 1)
    if ka != kb:
        return 0.0
    if ka == "exc":
        return 0.8 if va in vb or vb in va else 0.0
    if ka == "msg":
        x, y = set(va.split()), set(vb.split())
        return len(x & y) / len(x | y) if x and y else 0.0
    return 0.0


def leaders(signatures, frames):
    """signature -> leader, walking signatures in order."""
    taken = {}
    for i, s in enumerate(signatures):
        if s in taken:
            continue
        taken[s] = s
        for t in signatures[i + 1:]:
            if t not in taken and (jaccard_like(s, t) >= 0.5 or len(frames[s] & frames[t]) >= 2):
                taken[t] = s
    return taken


def merge_sets(items):
    """session -> group of sessions merged until no two groups share two words or a frame."""
    groups = [({s}, set(w), set(f)) for s, (w, f) in sorted(items.items())]
    changed = True
    while changed:
        changed = False
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                a, b = groups[i], groups[j]
                if len(a[1] & b[1]) >= 2 or a[2] & b[2]:
                    groups[i] = (a[0] | b[0], a[1] | b[1], a[2] | b[2])
                    del groups[j]
                    changed = True
                    break
            if changed:
                break
    return {frozenset(g[0]) for g in groups}


def overlap_walk(rows, better):
    """Rows (start, end, pos, score) of one file in order; returns kept rows."""
    kept = []
    for r in sorted(rows):
        for i, k in enumerate(kept):
            if k[0] <= r[1] and r[0] <= k[1]:
                if better(r[3], k[3]):
                    kept[i] = r
                break
        else:
            kept.append(r)
    return kept


def entry_blocks(lines, opens, cap):
    """(first, last) line numbers of log entries with a cap on lines."""
    out, current, start = [], 0, 1
    for n, line in enumerate(lines, 1):
        if opens(line):
            if current:
                out.append((start, start + current - 1))
            current, start = 1, n
        else:
            current += 1
            if current >= cap:
                out.append((start, start + current - 1))
                current, start = 0, n + 1
    if current:
        out.append((start, start + current - 1))
    return out


def budget(sections, limit):
    kept, used = [], 0
    for s in sections:
        if used + len(s) > limit:
            left = limit - used
            if left <= 200:
                continue
            s = s[: left - 50] + "\n\n[...context truncated for safety]"
        kept.append(s)
        used += len(s)
    return kept


def brace_end(lines, start):
    depth, opened = 0, False
    for i in range(start, len(lines)):
        for ch in lines[i]:
            if ch == "{":
                depth, opened = depth + 1, True
            elif ch == "}":
                depth -= 1
                if opened and depth == 0:
                    return i
    return len(lines) - 1
