"""The block rules a second time: a tree from the standard parser, and the nearest decided block by plain search."""

import re
from html.parser import HTMLParser

from lithospark.llm.html_extract import BLOCK_TAGS, HINTS, HOLDERS, LINKS, LONG, NAMES, OUTSIDE, RAW, ROLES, STOP_DENSITY, STOP_WORDS, TOPS


class Blocks(HTMLParser):
    """Blocks of well-formed pages: dicts of text, linked text and the open elements around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out, self.now, self.muted, self.link, self.n = [], [], None, 0, 0, 0

    def flush(self):
        if self.now and " ".join(self.now["text"].split()):
            self.out.append(self.now)
        self.now = None

    def handle_starttag(self, tag, attrs):
        if tag in RAW:
            if tag == "head":
                self.flush()
            self.muted += 1
            return
        if tag == "br":
            self.handle_data(" ")
        if tag == "a":
            self.link = 1
        if tag in BLOCK_TAGS:
            self.flush()
            self.link = 0
        if tag in HOLDERS:
            self.n += 1
            self.open.append((tag, {k: v or "" for k, v in attrs}, self.n))

    def handle_endtag(self, tag):
        if tag in RAW:
            self.muted = max(0, self.muted - 1)
            return
        if tag == "a":
            self.link = 0
        if tag in BLOCK_TAGS:
            self.flush()
        if any(o[0] == tag for o in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.muted:
            if self.now is None:
                self.now = {"text": "", "linked": "", "in": list(self.open)}
            self.now["text"] += data
            self.now["linked"] += data if self.link else ""


def judged(page):
    parser = Blocks()
    parser.feed(page)
    parser.close()
    parser.flush()
    blocks = parser.out
    for b in blocks:
        b["text"], b["linked"] = " ".join(b["text"].split()), " ".join(b["linked"].split())
        inner = [(k, o) for k, o in enumerate(b["in"]) if o[0] in ("article", "main")]
        b["article"] = inner[0][1][2] if inner else 0
        within = lambda k: any(j < k for j, _ in inner)  # noqa: B023, E731
        b["bad"] = any(o[0] in OUTSIDE and not (o[0] == "header" and within(k)) or "hidden" in o[1] or o[1].get("role") in ROLES for k, o in enumerate(b["in"]))
        tokens = [(within(k), t) for k, o in enumerate(b["in"]) if o[0] not in ("article", "main") for c in ("class", "id") for t in o[1].get(c, "").split()]
        b["named"] = any(NAMES.fullmatch(t) for _, t in tokens)
        b["short"] = any(HINTS.fullmatch(t) or not inside and TOPS.fullmatch(t) for inside, t in tokens)
    return blocks


def plain_text(page):
    """For pages whose names reject nothing around an article, and with text left."""
    blocks = judged(page)
    long = [b["text"] for b in blocks if len(b["text"]) >= LONG]
    own = {w for w in {x for t in long for x in t.lower().split() if len(x) <= 4 and x.isalpha()} if sum(w in t.lower().split() for t in long) >= max(3, len(long) / 5)}

    def label(b):
        if b["bad"] or b["named"]:
            return False
        if len(b["linked"]) > LINKS * len(b["text"]):
            return None if b["article"] else False
        if len(b["text"]) < LONG:
            return False if b["short"] else None
        words = b["text"].lower().split()
        share = sum(w in own or w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
        letters = re.findall(r"[^\W\d_]", b["text"])
        foreign = 2 * sum(bool(re.match("[A-Za-zª-ɏḀ-ỿ]", c)) for c in letters) < len(letters)
        return True if share >= STOP_DENSITY or foreign else None

    labels = [label(b) for b in blocks]
    inside = any(b["article"] and not (b["bad"] or b["named"]) for b in blocks)
    kept = []
    for i, b in enumerate(blocks):
        keep = labels[i]
        if not any(labels) and not inside:
            keep = not (b["bad"] or b["named"] or len(b["linked"]) > LINKS * len(b["text"]))
        elif keep is None:
            peers = [(abs(j - i), labels[j]) for j, other in enumerate(blocks) if labels[j] is not None and other["article"] == b["article"] and not (b["article"] and (other["bad"] or other["named"]))]
            # Of those before and after only the nearest of each side counts; the search over all finds the same distance.
            nearest = {x for d, x in peers if d == min(d for d, _ in peers)}
            keep = (bool(b["article"]) or not inside) if not peers or not any(labels) else (nearest.pop() if len(nearest) == 1 else bool(b["article"]))
        if keep:
            kept.append(b["text"])
    return " ".join(kept)
