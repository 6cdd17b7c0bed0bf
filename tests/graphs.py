"""Random small graphs, and plain loops that say what the operators must give."""

import random


class Small:
    """A graph of text: segments, lines of paths, links between their steps."""

    def __init__(self, seed, nodes=40, lines=8, revisits=True):
        rng = random.Random(seed)
        self.length = {n: rng.choice([1, 2, 3, 5, 9, 30]) for n in range(1, nodes + 1)}
        on = [n for n in range(1, nodes + 1) if n % 4]
        steps = []
        for k, n in enumerate(on):
            steps.append((n, rng.random() < 0.1))
            if revisits and rng.random() < 0.3:
                steps += [(m, rng.random() < 0.2) for m in rng.choices(on[max(0, k - 8) : k + 1], k=rng.choice([1, 2, 3]))]
        cut = len(steps) * 2 // 3
        first, second = steps[:cut], steps[cut:]
        bp = sum(self.length[n] for n, _ in first)
        #: (name, start, steps): two lines of the reference with a hole between, then the others.
        self.lines = [("R#0#x", 0, first), ("R#0#x", bp + 7, second)]
        for k in range(lines):
            name, start = f"H{k}#1#c", rng.randrange(20)
            for _ in range(rng.choice([1, 1, 2, 3])):
                walk, at = [], rng.randrange(len(steps))
                for _ in range(rng.randrange(3, 30)):
                    r = rng.random()
                    if r < 0.2:
                        walk.append((rng.choice([n for n in self.length if n % 4 == 0]), rng.random() < 0.5))
                    elif r < 0.3:
                        at = rng.randrange(len(steps))
                    if 0 <= at < len(steps):
                        walk.append(steps[at])
                        at += 1
                if rng.random() < 0.3:
                    walk = [(n, not r) for n, r in reversed(walk)]
                if rng.random() < 0.2:
                    walk = [(n, r) for n, r in walk if n % 4 == 0]
                if walk:
                    self.lines.append((name, start, walk))
                    start += sum(self.length[n] for n, _ in walk) + rng.choice([0, 4])

    def text(self, p_lines=False):
        out = [f"S\t{n}\t*\tLN:i:{l}" for n, l in self.length.items()]
        links = {}
        for _, _, steps in self.lines:
            for (a, ar), (b, br) in zip(steps, steps[1:]):
                if (b, not br, a, not ar) not in links:
                    links[a, ar, b, br] = None
        sign = "+-"
        out += [f"L\t{a}\t{sign[ar]}\t{b}\t{sign[br]}\t0M" for a, ar, b, br in links]
        for name, start, steps in self.lines:
            if p_lines:
                out.append(f"P\t{name}[{start}]\t" + ",".join(f"{n}{sign[r]}" for n, r in steps) + "\t*")
            else:
                end = start + sum(self.length[n] for n, _ in steps)
                out.append("\t".join(["W", *name.split("#"), str(start), str(end), "".join("><"[r] + str(n) for n, r in steps)]))
        return "\n".join(out) + "\n"

    def reference(self):
        """Passes over each node: (offset, rev), in order."""
        passes = {}
        for name, start, steps in self.lines:
            if name.startswith("R#"):
                for n, r in steps:
                    passes.setdefault(n, []).append((start, r))
                    start += self.length[n]
        return {n: sorted(p) for n, p in passes.items()}


def placed(graph, line, tile, stay):
    """A line's steps: (node, rev, offset, pass or None, tile), by the rules read as plain loops over the whole line."""
    passes, size = graph.reference(), graph.length
    name, start, walk = line
    steps, at = [], start
    for n, r in walk:
        steps.append((n, r, at))
        at += size[n]
    on = [k for k, s in enumerate(steps) if s[0] in passes]
    if not on:
        return []
    if name.startswith("R#"):
        return [(n, r, o, (o, r), o // tile * tile) for n, r, o in steps]

    def guess(k, was, j):
        n, r, o = steps[k]
        gone = steps[j][2] - o
        return was[0] + gone if r == was[1] else was[0] + size[n] - gone - size[steps[j][0]]

    once = [k for k in on if len(passes[steps[k][0]]) == 1]
    anchor = once[0] if once else on[0]
    took = {anchor: passes[steps[anchor][0]][0]}
    for way in ([k for k in on if k > anchor], [k for k in on[::-1] if k < anchor]):
        k = anchor
        for j in way:
            want = guess(k, took[k], j)
            took[j] = min(passes[steps[j][0]], key=lambda p: (abs(p[0] - want), p[0]))
            k = j
    home, last = [], None
    for k in range(len(steps)):
        last = took[k][0] // tile * tile if k in took else last
        home.append(last)
    first = next(h for h in home if h is not None)
    home = [first if h is None else h for h in home]
    here, k = home[0], 1
    while stay and k < len(steps):
        if home[k] == here:
            k += 1
            continue
        j, bp, single = k, 0, False
        while j < len(steps) and home[j] != here and bp <= stay:
            if steps[j][0] in passes:
                bp += size[steps[j][0]]
                single |= len(passes[steps[j][0]]) == 1
            j += 1
        good, moves = j < len(steps) and home[j] == here and bp <= stay and not single, {}
        before = [x for x in range(k) if x in took]
        prev = before[-1] if before else None
        known = dict(took)
        for x in range(k, j) if good else ():
            if x not in took:
                continue
            inside = [p for p in passes[steps[x][0]] if here <= p[0] < here + tile]
            if not inside:
                moves[x] = None
                continue
            want = None if prev is None else guess(prev, known[prev], x)
            best = None if want is None else min(inside, key=lambda p: abs(p[0] - want))
            if best is None or abs(best[0] - want) > stay:
                good = False
                break
            moves[x] = known[x] = best
            prev = x
        if good:
            for x, p in moves.items():
                if p is None:
                    del took[x]
                else:
                    took[x] = p
            home[k:j] = [here] * (j - k)
            k = j
        else:
            here, k = home[k], k + 1
    return [(n, r, o, took.get(k), home[k]) for k, (n, r, o) in enumerate(steps)]


def pieces(rows):
    """Runs of steps in one tile."""
    out = []
    for row in rows:
        if not out or out[-1][0] != row[4]:
            out.append((row[4], []))
        out[-1][1].append(row)
    return out
