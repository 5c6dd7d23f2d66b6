"""Main text of web pages by equivalence-class template deduction.

The tokens of a page are its tags and words, each told apart by the path of
elements that holds it; words count in texts that could be printed as a whole
on every page, none of whose words comes twice under its path.  A token's occurrence vector lists how often each page
of the host has it.  Tokens of one host with equal vectors form an equivalence
class: what the host's template prints together.  Vectors are compared by two
sums over pages of a hash of the page and the count, so a class is found by
adding numbers and no page list is ever gathered, however many pages a host has.

A class is kept if it has two tokens or more and lies on half of the host's
pages.  Every page then checks it: its tokens have to come in one order, over
and over, and an occurrence of one class has to lie between two neighbouring
tokens of another.  Tokens that break the order anywhere, and classes that
break the nesting, are dropped.  What stays is the template: the class that is
on every page once is its frame, the others nest in its slots.  Text is what
the slots hold; a block made of nothing but frame tokens is a notice that every
page repeats, and goes where notices are the smaller part of the page.

Slots are chosen for a host as a whole.  Slots within navigation, asides,
footers, forms, notices and reader comments, known by element, role or class,
are left out.  Pages with an article or a main element give what stands there.
On other hosts the slots of the narrowest template element are taken that holds
``SHARE`` of the running words, less slots whose words are mostly links.  Hosts
with fewer than ``LEAST_PAGES`` pages of different text have no template; each of
their pages is its own evidence.

Defined results
    null html                       empty text
    null url, or no ``://``         pages of the empty host
    null or repeated page_id, repeated rows   each row gives its text; equal pages are one page when pages are counted
    unclosed tags, cut-off pages    read as far as they go
    very long pages                 read whole
    extra columns                   ignored
    empty table                     no rows
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.markup import BLOCK, HOLDERS, IN_MAIN, IS_AROUND, IS_NEVER, OPEN, TEXT, Event, events
from skyloom.llm.rows import bounded
from skyloom.llm.url_filter import host_of
from skyloom.llm.words import mixed
from skyloom.operators.scale import enrich
from skyloom.session import materialise

#: Pages that differ, which a host needs for a template; share of the running words that the chosen element holds; share of linked words in menus.
LEAST_PAGES, SHARE, LINKED = 8, 0.8, 0.5
#: Hosts whose templates are broadcast, about ten kilobytes each; more are joined by a shuffle with hot hosts spread.
BROADCAST_HOSTS = 2_000

_WHITE = re.compile(r"[\x20\x09-\x0D]+")
#: The token that every page has once: the page itself.  Pages whose vectors are added up at once.
PAGE, PAGES_AT_ONCE = 0, 1000


class _Names:
    """64-bit names of tokens: tags are even, words odd with their path's name in the upper bits."""

    def __init__(self) -> None:
        self.tags: dict[tuple[int, str], int] = {}
        self.paths: dict[str, int] = {}

    def tag(self, event: Event) -> int:
        key = (event.kind, event.path)
        found = self.tags.get(key)
        if found is None:
            digest = xxhash.xxh64_intdigest(("<" if event.kind == OPEN else ">") + event.path)
            found = self.tags[key] = (digest >> 2 << 1) or 2
        return found

    def path(self, path: str) -> int:
        found = self.paths.get(path)
        if found is None:
            found = self.paths[path] = xxhash.xxh64_intdigest(path) >> 41
        return found

    def words(self, path: str, words: list[str]) -> list[int]:
        base = self.path(path) << 40
        return [base | xxhash.xxh64_intdigest(w) >> 25 << 1 | 1 for w in words]


def _page_tokens(page: str, names: _Names) -> tuple[list[int], str]:
    """The tokens of a page in order, and the text outside of known surroundings.

    Words are tokens only in texts all of whose words stand once on the page
    under their path: others could never be part of a frame as a whole.
    """
    runs: list[Event] = list(events(page))
    counts: dict[str, Counter[str]] = {}
    words, inner = [], []
    for event in runs:
        own = event.value.split() if event.kind == TEXT else None
        words.append(own)
        if own:
            counts.setdefault(event.path, Counter()).update(own)
            if event.part not in (IS_NEVER, IS_AROUND):
                inner += own
    tokens: list[int] = []
    for event, own in zip(runs, words):
        if own is None:
            tokens.append(names.tag(event))
        elif own:
            count = counts[event.path]
            if all(count[w] == 1 for w in own):
                tokens += names.words(event.path, own)
    return tokens, " ".join(inner)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host and token of some pages the sums that make its occurrence vector, and of its first positions.

    A word goes on only if each of the host's pages at hand has it once; any
    other cannot be in the frame.
    """
    names = _Names()
    for whole in batches:
        for start in range(0, whole.num_rows, PAGES_AT_ONCE):
            batch = whole.slice(start, PAGES_AT_ONCE)
            token, times, first, page, host, alike = [], [], [], [], [], []
            for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                found, inner = _page_tokens(html or "", names)
                counts = Counter(found)
                seen: dict[int, int] = {}
                for position, t in enumerate(found):
                    seen.setdefault(t, position)
                counts[PAGE], seen[PAGE] = 1, 0
                n = len(counts)
                token += counts.keys()
                times += counts.values()
                first += [seen[t] for t in counts]
                page += [xxhash.xxh64_intdigest(html or "")] * n
                alike += [1 << xxhash.xxh64_intdigest(inner) % 63] * n
                host += [name] * n
            code = pa.array(host, pa.string()).dictionary_encode()
            owner = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            token, times = np.array(token, np.int64), np.array(times, np.int64)
            vector = mixed(np.array(page, np.uint64) ^ (times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            order = np.lexsort((token, owner))
            owner, token = owner[order], token[order]
            heads = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (token[1:] != token[:-1]))) if len(owner) else np.zeros(0, np.int64)

            def total(values: np.ndarray, add: np.ufunc = np.add) -> np.ndarray:
                return add.reduceat(values[order], heads) if len(heads) else np.zeros(0, np.int64)

            owner, token, pages, sums = owner[heads], token[heads], total(np.ones(len(token), np.int64)), total(times)
            here = np.zeros(len(code.dictionary), np.int64)
            here[owner[token == PAGE]] = pages[token == PAGE]
            kept = (token % 2 == 0) | ((pages == here[owner]) & (sums == pages))
            columns = [
                code.dictionary.take(pa.array(owner[kept])),
                *(pa.array(c[kept]) for c in (
                    token, pages, sums, total((vector >> np.uint64(34)).astype(np.int64)), total((vector & np.uint64((1 << 30) - 1)).astype(np.int64)),
                    total(np.array(first, np.int64)), total(np.array(alike, np.int64), np.bitwise_or),
                )),
            ]
            yield pa.record_batch(columns, names=["host", "token", "pages", "times", "high", "low", "first", "alike"])


def classes(pages: DataFrame) -> DataFrame:
    """host, pages, and for each token of a class its class and place in it, frame class first; ``pages`` is (host, html).

    One row for each host that has enough pages; it holds tokens that lie on
    half of the pages, so it grows with the template and not with the host.
    """
    schema = "host string, token long, pages long, times long, high long, low long, first long, alike long"
    sums = [F.sum(c).alias(c) for c in ("pages", "times", "high", "low", "first")]
    tokens = pages.mapInArrow(_vectors, schema).groupBy("host", "token").agg(*sums, F.bit_or("alike").alias("alike"))
    tokens = materialise(tokens.filter(F.col("pages") >= F.when(F.col("token") == PAGE, 1).otherwise(LEAST_PAGES)), "tokens")
    hosts = tokens.filter((F.col("token") == PAGE) & (F.bit_count("alike") >= LEAST_PAGES)).select("host", F.col("pages").alias("all"))
    common = tokens.filter(F.col("token") != PAGE).join(bounded(materialise(hosts, "hosts")), "host").filter(2 * F.col("pages") >= F.col("all"))
    common = common.filter((F.col("token") % 2 == 0) | ((F.col("pages") == F.col("all")) & (F.col("times") == F.col("all"))))
    members = F.array_sort(F.collect_list(F.struct("first", "token"))).alias("members")
    grouped = common.groupBy("host", "all", "pages", "times", "high", "low").agg(members).filter(F.size("members") > 1)
    frame = (F.col("pages") == F.col("all")) & (F.col("times") == F.col("all"))
    one = F.struct((~frame).alias("inner"), (-F.col("pages")).alias("rank"), "high", "low", F.transform("members", lambda m: m["token"]).alias("tokens"))
    rows = grouped.groupBy("host").agg(F.array_sort(F.collect_list(one)).alias("classes"))
    return rows.select("host", F.transform("classes", lambda c: F.struct(c["inner"].alias("inner"), c["tokens"].alias("tokens"))).alias("classes"))


class _Template:
    """Classes of a host: for each token its class and place; the frame's tokens, and the paths that have words of it."""

    def __init__(self, found: list[dict] | None, dropped: set[int] = frozenset()) -> None:
        self.at: dict[int, tuple[int, int]] = {}
        self.length: list[int] = []
        self.inner: list[bool] = []
        self.frame: set[int] = set()
        self.worded: set[int] = set()
        for c in found or ():
            kept = [t for t in c["tokens"] if t not in dropped]
            if len(kept) > 1:
                for place, t in enumerate(kept):
                    self.at[t] = (len(self.length), place)
                self.length.append(len(kept))
                self.inner.append(c["inner"])
                if not c["inner"]:
                    self.frame.update(kept)
                    self.worded = {t >> 40 for t in kept if t % 2}


class _Walk:
    """Follows one page through its host's template."""

    def __init__(self, template: _Template) -> None:
        self.template = template
        self.open: list[list[int]] = []  # class, place and token last met
        self.broken: set[int] = set()

    def slot(self) -> int:
        return self.open[-1][2] if self.open else PAGE

    def meet(self, token: int) -> bool:
        """Take a token; True if the template has it."""
        spot = self.template.at.get(token)
        if spot is None:
            return False
        own, place = spot
        depth = next((d for d in range(len(self.open) - 1, -1, -1) if self.open[d][0] == own), None)
        if depth is None:
            if place:
                self.broken.add(token)  # the occurrence has not begun
                return True
            self.open.append([own, 0, token])
        else:
            # what is still open within was cut off by this token
            for cut in self.open[depth + 1 :]:
                self.broken.add(cut[2])
            del self.open[depth + 1 :]
            if place != self.open[depth][1] + 1:
                self.broken.add(token)
            self.open[depth][1:] = [place, token]
        if place == self.template.length[own] - 1 and self.template.inner[own]:
            self.open.pop()  # an occurrence is complete; the next begins anew
        return True


@lru_cache(100_000)
def _container(path: str) -> str:
    """The path of the innermost element that holds blocks."""
    parts = path.split("/")
    while len(parts) > 1 and parts[-1].split(".")[0] not in HOLDERS:
        parts.pop()
    return "/".join(parts)


_VOTES = "host string, token long, path string, broken long, words long, linked long"


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host: how often a token broke its class, and what the slots of pages without a main element hold.

    That is words outside of known surroundings, and how many of them are in links.
    """
    names = _Names()
    for batch in batches:
        known: dict[str, _Template] = {}
        sums: dict[tuple[str, int, str], list[int]] = {}
        for host, html, found in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("classes")):
            if not found.is_valid:
                continue
            template = known.get(host)
            if template is None:
                template = known[host] = _Template(found.as_py())
            walk = _Walk(template)
            held: list[tuple[Event, int, int]] = []
            for event in events(html or ""):
                if event.kind != TEXT:
                    walk.meet(names.tag(event))
                    continue
                words, slot = event.value.split(), walk.slot()
                if words and names.path(event.path) in template.worded:
                    for token in names.words(event.path, words):
                        walk.meet(token)
                if words and event.part not in (IS_NEVER, IS_AROUND):
                    held.append((event, slot, len(words)))
            if not any(event.part == IN_MAIN for event, _, _ in held):
                for event, slot, n in held:
                    own = sums.setdefault((host, slot, _container(event.path)), [0, 0, 0])
                    own[1] += n
                    own[2] += n * event.linked
            for token in walk.broken:
                sums.setdefault((host, token, ""), [0, 0, 0])[0] += 1
            sums.setdefault((host, PAGE, ""), [0, 0, 0])  # a host without findings is decided too
        rows = [(*key, *values) for key, values in sums.items()]
        columns = list(zip(*rows)) or [()] * 6
        types = (pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "token", "path", "broken", "words", "linked"])


def chosen_path(words: dict[str, int]) -> str:
    """The narrowest element that holds ``SHARE`` of the words: its path."""
    total = sum(words.values())
    held: Counter[str] = Counter()
    for path, n in words.items():
        while path:
            held[path] += n
            path = path.rpartition("/")[0]
    enough = [p for p, n in held.items() if n >= SHARE * total]
    return max(enough, key=lambda p: (p.count("/"), p), default="")


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host the tokens to drop from its classes, and the path of the element and the slots to take."""
    for batch in batches:
        dropped, paths, taken = [], [], []
        for cells in batch.column("cells").to_pylist():
            running: Counter[str] = Counter()
            linked: dict[int, list[int]] = {}
            for c in cells:
                running[c["path"]] += c["words"] - c["linked"]
                own = linked.setdefault(c["token"], [0, 0])
                own[0] += c["words"]
                own[1] += c["linked"]
            del running[""]  # texts outside of any element
            path = chosen_path(running)
            dropped.append([c["token"] for c in cells if c["broken"]])
            paths.append(path)
            taken.append(sorted(t for t, (words, links) in linked.items() if words and links > LINKED * words))
        columns = [batch.column("host"), pa.array(dropped, pa.list_(pa.int64())), pa.array(paths, pa.string()), pa.array(taken, pa.list_(pa.int64()))]
        yield pa.record_batch(columns, names=["host", "dropped", "path", "menus"])


def _blocks(page: str, walk: _Walk, names: _Names) -> Iterator[tuple[str, str, int, int, bool, bool]]:
    """(text, container, part, slot, whether it is all frame words, whether mostly linked) of every block with text."""
    parts: list[str] = []
    first: tuple[Event, int] | None = None
    linked = notice = n = 0

    def done() -> Iterator[tuple[str, str, int, int, bool, bool]]:
        nonlocal parts, first, linked, notice, n
        text = _WHITE.sub(" ", "".join(parts)).strip(" ")
        if text and first is not None:
            yield text, _container(first[0].path), first[0].part, first[1], bool(n) and notice == n, linked > LINKED * n
        parts, first, linked, notice, n = [], None, 0, 0, 0

    for event in events(page):
        if event.kind != TEXT:
            if event.value in BLOCK:
                yield from done()
            elif event.value == "br":
                parts.append(" ")
            walk.meet(names.tag(event))
            continue
        words, slot, met = event.value.split(), walk.slot(), ()
        if words and names.path(event.path) in walk.template.worded:
            met = names.words(event.path, words)
            for token in met:
                walk.meet(token)
        if event.part in (IS_NEVER, IS_AROUND):
            continue
        parts.append(event.value)
        if words:
            first = first or (event, slot)
            n += len(words)
            linked += len(words) * event.linked
            notice += sum(t in walk.template.frame for t in met)
    yield from done()


def main_text(page: str, template: _Template, path: str | None, menus: set[int], names: _Names | None = None) -> str:
    """The chosen blocks of a page, one a line; ``path`` None: the page is its own evidence."""
    found = list(_blocks(page, _Walk(template), names or _Names()))
    if any(part == IN_MAIN for _, _, part, _, _, _ in found):
        taken = [(text, notice) for text, _, part, _, notice, _ in found if part == IN_MAIN]
    else:
        if path is None:
            running: Counter[str] = Counter()
            for text, container, _, _, _, linked in found:
                running[container] += 0 if linked else len(text.split())
            path = chosen_path(running)
        inside = [b for b in found if (b[1] + "/").startswith(path + "/")]
        taken = [(text, notice) for text, _, _, slot, notice, linked in inside if slot not in menus and not linked]
    said = sum(len(text.split()) for text, notice in taken if not notice)
    repeated = sum(len(text.split()) for text, notice in taken if notice)
    # what is most of a page is no notice, however many pages say it
    return "\n".join(text for text, notice in taken if not (notice and repeated < said))


_TEXTS = "page_id long, url string, text string, n_chars long"


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _Names()
    for batch in batches:
        known: dict[str, tuple] = {}
        none = (_Template(None), None, set(), names)
        texts = []
        hosts, pages, found = batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("classes")
        for row, (host, html) in enumerate(zip(hosts, pages)):
            own = none
            if found[row].is_valid:
                own = known.get(host)
                if own is None:
                    dropped, path, menus = (batch.column(c)[row].as_py() for c in ("dropped", "path", "menus"))
                    own = known[host] = (_Template(found[row].as_py(), set(dropped or ())), path, set(menus or ()), names)
            texts.append(main_text(html or "", *own))
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.record_batch(columns, names=["page_id", "url", "text", "n_chars"])


def _with_template(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Pages with the columns of their host's row, null where there is none."""
    if templates.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        return pages.join(F.broadcast(templates), "host", "left")
    return enrich(pages, templates, ["host"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    placed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    found = materialise(classes(placed.select("host", "html")), "classes")
    votes = _with_template(placed.select("host", "html"), found).mapInArrow(_votes, _VOTES)
    sums = votes.groupBy("host", "token", "path").agg(*[F.sum(c).alias(c) for c in ("broken", "words", "linked")])
    cells = sums.groupBy("host").agg(F.collect_list(F.struct("token", "path", "broken", "words", "linked")).alias("cells"))
    decided = cells.mapInArrow(_decided, "host string, dropped array<long>, path string, menus array<long>")
    templates = materialise(found.join(decided, "host"), "templates")
    return _with_template(placed, templates).mapInArrow(_extracted, _TEXTS)
