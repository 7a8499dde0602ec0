"""Plain versions of the tag operators, for comparison."""

from __future__ import annotations

import re

from tagweave.functions import vocab


def parse(text):
    return text.replace(", ", ",").replace("  ", " ").split(",")


def join(tags):
    return "".join(t if t == tags[-1] else t + ", " for t in tags)


def within(a, b):
    return re.search(r"\b" + re.escape(a) + r"\b", b, re.I) is not None


def redundant(a, b):
    return within(a, b) or within(b, a)


def meets(tag, words, ruled_out):
    if words is None:
        return "eyewear" in tag
    return not any(x in tag for x in ruled_out) and any(w in tag.lower() for w in words)


class Slots:
    """A set that reuses the slot freed last."""

    def __init__(self):
        self.slots, self.free = [], []

    def items(self):
        return [x for x in self.slots if x is not None]

    def remove(self, tag):
        i = self.slots.index(tag)
        self.slots[i] = None
        self.free.append(i)

    def add(self, tag):
        if tag in self.items():
            return
        if self.free:
            self.slots[self.free.pop()] = tag
        else:
            self.slots.append(tag)


def without_redundant(text):
    tags, kept, held = parse(text), Slots(), set()
    for tag in tags:
        lesser = False
        for p in kept.items():
            if redundant(tag, p):
                if len(tag) < len(p):
                    lesser = True
                else:
                    kept.remove(p)
                    break
        own = [(n, several) for n, words, out, several in vocab.CATEGORIES if meets(tag, words, out)]
        free = next((x for x in own if x[0] not in held), None)
        if free:
            kept.add(tag)
            if not any(t.lower() in free[1] for t in tags):
                held.add(free[0])
        elif not own and not lesser:
            for p in kept.items():
                if redundant(p, tag):
                    kept.remove(p)
            kept.add(tag)
    out = [t for t in kept.items() if t.lower() not in vocab.STOP_TAGS]
    return join(out)
