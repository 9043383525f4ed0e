"""HTML extraction: page structure plus suffix arrays over each host's pages.

A page is read into blocks and boxes (articles, sections, divisions and the like). Blocks inside
menus, headers, footers, sidebars, notices, adverts, forms and reader comments (by element, role,
class or id) are left out, and so is what is no text; headings in an article's own header stay,
and a box named like content stays if it holds most of the page's words. If the page has an
article (else a main) element, its blocks are the page's article; articles of less than a quarter
of the longest one's words are teasers and left out. All other blocks are undecided. The host
decides on both by the repeated runs of its pages: token streams are concatenated with a
different separator for each page (the articles' words by block, as streams of their own), and a
suffix array, sorted to a depth of RUN tokens, gives the groups of equal runs. Runs on at least
MIN_PAGES distinct pages of the host are boilerplate outside articles. In articles they are so
if they also stand in more than half of the host's distinct articles: passages that fewer
articles share are their text.

  1. On a page without an article, the main box is the innermost one that still holds MAIN of the
     words around it. If at least half of its words are in no repeated run, it is main text and
     stays whole; so it does if the page has no other word either, being a copy of others.
  2. Of all other undecided blocks the words covered by repeated runs go and the unique runs
     stay; a block between blocks of the same box with unique words is part of their text.
  3. Of an article the blocks that such runs cover from end to end go (notices, adverts and the
     like that no name tells), unless they hold more than half of its words: then it is a copy of
     others and stays whole. Shorter blocks than RUN words stay.

Skew: the pages of a host are dealt by a hash into shards of about SHARD_PAGES pages, and an
array is built over each Arrow batch of a shard (ids are those of a host's tokens, so that
hosts may share one). Its groups are only partial counts: they are summed by a hash of host
and run, and the runs at the limit are joined back to the pages with undecided words, the most
frequent by broadcast. Articles are dealt likewise, equal ones together: a run in more than half
of a host's is in more than half of one shard's, so only such runs are sought and counted in all
of the host's articles. What is dealt are two bytes of each word's hash: equal runs stay equal,
and the count is by 64 bits. So the shards do not show in the result.

Defined results: null or empty html gives empty text; a page cut off anywhere is read as far
as it goes; end tags that close nothing are skipped, and reading is linear in the page;
repeated rows each get a row; an empty table gives none; extra columns, whatever their names,
are ignored; a null url is a host of its own.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RUN, MIN_PAGES, SHARD_PAGES, MAIN = 6, 3, 400, 0.8
#: Bytes of articles' codes in one suffix array; a shard with more makes several.
ARRAY_BYTES = 2 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|iframe|noscript|template|svg|math|object|title|xmp|noembed|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)"""
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul video audio".split()
)
LEFT_OUT = frozenset("head nav header footer aside form dialog menu select button option audio video canvas label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification "
    "menu nav navbar navigation sidebar aside breadcrumb breadcrumbs footer header masthead comment comments respond disqus share sharing social "
    "related recommended newsletter popup modal subscribe pagination pager widget toolbar".split()
)
#: An opening tag that ends an open element of these names.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article main section div body table td th ul ol dl nav aside header footer form blockquote".split())


_KEYS = _SCOPE | frozenset("li dt dd tr td th option p".split())
_BOXES = frozenset("article main section div body table td center".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Names of boxes with main text; beside one of NAMES they leave the box in doubt.
_CONTENT = frozenset("content article main post entry story body page wrapper container layout text".split())
_HARD, _SOFT, _DOUBT, _MAIN, _ARTICLE, _HEAD = 1, 2, 4, 8, 16, 32


def _marks(tag: str, rest: str) -> int:
    """What an element's name and attributes say about it."""
    if tag in LEFT_OUT:
        return _HARD
    out = _ARTICLE if tag == "article" else _MAIN if tag == "main" else 0
    if not rest or tag in ("html", "body", "main"):
        return out
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return _HARD
        if name == "role" and value in ROLES:
            return _HARD
        if name == "role" and value == "main":
            out |= _MAIN
        if name in ("class", "id"):
            own = re.split(r"[^a-z0-9]+", value)
            out |= (0 if NAMES.isdisjoint(own) else _SOFT) | (0 if _CONTENT.isdisjoint(own) else _DOUBT)
    return out


class _Page:
    """Boxes (parent and marks of each; box 0 is the page) and events: tags, and blocks as (box, words)."""

    def __init__(self, page: str):
        self.parent, self.mark, self.in_article, self.events = [0], [0], [False], []
        stack: list[tuple[str, int]] = []  # tag, box
        keys: list[int] = []  # places in the stack of tags that may end others or stop the search
        open_tags: Counter[str] = Counter()
        text: list[str] = []
        box = at = 0

        def close():
            if text:
                words = entities.unescape("".join(text)).split()
                text.clear()
                if words:
                    self.events.append((box, words))

        def cut(i: int):
            nonlocal box
            under = stack[i - 1][1] if i else 0
            if under != box:
                close()
                box = under
            for t, _ in stack[i:]:
                open_tags[t] -= 1
            del stack[i:]
            while keys and keys[-1] >= i:
                keys.pop()

        for m in _TOKEN.finditer(page):
            if m.start() > at:
                text.append(page[at : m.start()])
            at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag:
                if m["raw"] and m["raw"].lower() in ("textarea", "iframe", "object", "xmp"):
                    text.append(" ")
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag in BLOCK:
                close()
                self.events.append(m["end"] + tag)
            elif tag in VOID:
                continue
            if m["end"]:
                if open_tags[tag]:  # what is searched is closed
                    cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
                continue
            ends = _ENDS.get(tag) or (tag in BLOCK and {"p"})
            if ends and any(open_tags[t] for t in ends):
                for i in reversed(keys):
                    if stack[i][0] in ends:
                        cut(i)
                        break
                    if stack[i][0] in _SCOPE:
                        break
            if tag in VOID or m["rest"].endswith("/"):
                continue
            marks, parent = _marks(tag, m["rest"]), box
            if tag == "header" and self.in_article[box]:
                marks |= _HEAD
            head = tag in _HEADINGS and self.mark[box] & _HEAD
            if marks & ~_DOUBT or head or tag in _BOXES:
                close()
                parent = self.parent[box] if head else box
                self.parent.append(parent)
                self.mark.append(marks)
                self.in_article.append(self.in_article[parent] or bool(marks & _ARTICLE))
                box = len(self.parent) - 1
            stack.append((tag, box))
            open_tags[tag] += 1
            if tag in _KEYS:
                keys.append(len(stack) - 1)
        if at < len(page):
            text.append(page[at:])
        close()

    def below(self, hidden: list[bool]) -> list[int]:
        """Words in each box and the boxes in it, without those of hidden boxes."""
        mass = [0] * len(self.parent)
        for e in self.events:
            if not isinstance(e, str) and not hidden[e[0]]:
                mass[e[0]] += len(e[1])
        for i in range(len(mass) - 1, 0, -1):
            mass[self.parent[i]] += mass[i]
        return mass

    def inside(self, own: list[bool]) -> list[bool]:
        """Boxes that are marked or inside one that is."""
        out = list(own)
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parent[i]]
        return out

    def decided(self) -> tuple[list[bool], list[int]]:
        """Whether each box is left out, and its kind: 2 main text, 1 in the main box of a page without an article, 0 elsewhere."""
        n = range(len(self.parent))
        mass = self.below(self.inside([bool(m & _HARD) for m in self.mark]))
        out = [bool(m & _HARD) or bool(m & _SOFT) and not (m & _DOUBT and 2 * mass[i] > mass[0]) for i, m in enumerate(self.mark)]
        hidden = self.inside(out)
        mass = self.below(hidden)
        for mark in (_ARTICLE, _MAIN):
            some = [i for i in n if self.mark[i] & mark and mass[i] and not hidden[i]]
            if some:
                most = max(mass[i] for i in some)
                teaser = self.inside([i in some and mark == _ARTICLE and 4 * mass[i] < most for i in n] if len(some) > 1 else [False for _ in n])
                some = set(some)
                main = self.inside([i in some and not teaser[i] for i in n])
                return [h or t and not k for h, t, k in zip(hidden, teaser, main, strict=True)], [2 * k for k in main]
        inner: dict[int, list[int]] = {}
        for i in n[1:]:
            if not hidden[i]:
                inner.setdefault(self.parent[i], []).append(i)
        best = 0
        while best in inner and mass[top := max(inner[best], key=mass.__getitem__)] >= MAIN * mass[best] > 0:
            best = top
        return hidden, [int(k) for k in self.inside([best == i > 0 for i in n])]


def parse(page: str) -> tuple[list[tuple[int, str]], list[str], list[int]]:
    """Blocks that are not left out as (kind, text), the page's token stream, and the box of each block.

    The stream has tags and the words of all blocks but those of kind 2, whose texts are streams of
    their own; words that are not left out stand there as "", block, word joined by a tab."""
    read = _Page(page)
    hidden, kinds = read.decided()
    out, stream, boxes = [], [], []
    for e in read.events:
        if isinstance(e, str):
            stream.append(e)
            continue
        box, words = e
        if hidden[box]:
            stream += words
            continue
        if kinds[box] < 2:
            stream += [f"\t{len(out)}\t{w}" for w in words]
        out.append((kinds[box], " ".join(words)))
        boxes.append(box)
    return out, stream, boxes


def blocks(page: str) -> tuple[list[tuple[int, str]], list[str]]:
    return parse(page)[:2]


def _read(batches):
    for batch in C.small(batches):
        texts, kinds, boxes, undecided, streams = [], [], [], [], []
        for page in batch.column("html").to_pylist():
            own, stream, box = parse(page or "")
            texts.append([t if k == 2 else None for k, t in own])
            kinds.append([k for k, _ in own])
            boxes.append(box)
            undecided.append(any(k < 2 for k, _ in own))
            streams.append("\n".join(stream))
        names = [n for n in batch.schema.names if n != "html"]
        added = {"blocks": pa.array(texts, pa.list_(pa.string())), "kinds": pa.array(kinds, pa.list_(pa.int32())), "boxes": pa.array(boxes, pa.list_(pa.int32())), "undecided": pa.array(undecided, pa.bool_()), "stream": pa.array(streams, pa.string())}
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *added.values()], names=[*names, *added])


def suffix_ranks(ids: np.ndarray, run: int) -> np.ndarray:
    """The rank of each suffix among the suffixes cut at `run` tokens, by prefix doubling."""
    n = len(ids)
    rank, depth = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while depth < run:
        step = min(depth, run - depth)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        rank, depth = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64), depth + step
    return rank


def pages_of(rank: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each rank, and on how many distinct pages it stands."""
    order = np.argsort(rank, kind="stable")  # the suffix array, equal prefixes in page order
    group, own = rank[order], page[order]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    new_page = first | np.concatenate([[True], own[1:] != own[:-1]])
    return order[first], np.bincount(group, weights=new_page).astype(np.int64)


def repeated_runs(ids: np.ndarray, page: np.ndarray, run: int, at_least: int) -> np.ndarray:
    """Positions covered by runs of `run` tokens that stand on at least `at_least` distinct pages.

    Prefix doubling sorts the suffixes to a depth of `run` tokens; ids of separators are
    unique, so that no repeated run crosses from page to page.
    """
    n = len(ids)
    covered = np.zeros(n + 1, np.int64)
    if n < run:
        return covered[:n] > 0
    rank = suffix_ranks(ids, run)
    _, pages = pages_of(rank, page)
    starts = np.flatnonzero(pages[rank] >= at_least)
    starts = starts[starts <= n - run]
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + run, -1)
    return np.cumsum(covered[:n]) > 0


class _Streams:
    """Tokens of a batch of pages: ids by host and token, a hash for each, and the page of each."""

    def __init__(self, hosts: list[str], streams: list[str]):
        vocabulary: dict[tuple[str, str], int] = {}
        ids, counts = [], []
        for p, (host, stream) in enumerate(zip(hosts, streams, strict=True)):
            tokens = stream.split("\n") if stream else []
            ids += [vocabulary.setdefault((host, t.rpartition("\t")[2]), len(vocabulary)) for t in tokens] + [-1 - p]
            counts.append(len(tokens) + 1)
        named = [int.from_bytes(hashlib.blake2b(f"{h}\n{t}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for h, t in vocabulary]
        self.ids, self.page = np.array(ids, np.int64), np.repeat(np.arange(len(counts)), counts)
        self.first = np.cumsum([0, *counts])
        self.values = np.array([*named, 0], C.U)[np.maximum(self.ids, -1)]

    def inside(self, starts: np.ndarray, run: int) -> np.ndarray:
        """The starts whose run ends before the separator of their page."""
        return starts[starts + run < self.first[self.page[starts] + 1]]

    def hashes(self, starts: np.ndarray, run: int) -> np.ndarray:
        return C.span_hash(self.values, starts, starts + run).astype(np.int64)


def _count_runs(run: int):
    def count(batches):
        last = None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("host", "key", "stream")), strict=True))
            new = [r for r, before in zip(rows, [last, *(r[1] for r in rows)], strict=False) if r[1] != before]  # sorted: repeated rows are one page
            last = rows[-1][1] if rows else last
            s = _Streams([r[0] for r in new], [r[2] for r in new])
            runs, n = np.empty(0, np.int64), np.empty(0, np.int64)
            if len(s.ids) > run:
                places, pages = pages_of(suffix_ranks(s.ids, run), s.page)
                by_place = np.argsort(places)
                places, pages = places[by_place], pages[by_place]
                ok = s.inside(places, run)
                runs, n = s.hashes(ok, run), pages[np.searchsorted(places, ok)]
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(n, pa.int64())], names=["run", "n"])

    return count


def _places(run: int):
    """Runs of the pages that touch undecided words, and where they start."""

    def places(batches):
        for batch in C.small(batches):
            keys, hosts, streams = (batch.column(c).to_pylist() for c in ("key", "host", "stream"))
            s = _Streams(hosts, streams)
            asked = np.zeros(len(s.ids) + 1, np.int64)
            for first, stream in zip(s.first, streams):
                for i, t in enumerate(stream.split("\n")):
                    asked[first + i + 1] = t.startswith("\t")
            asked = np.cumsum(asked)
            starts = s.inside(np.arange(max(0, len(s.ids) - run)), run)
            starts = starts[asked[starts + run] > asked[starts]]
            of = s.page[starts]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[of], pa.int64()), pa.array(s.hashes(starts, run), pa.int64()), pa.array((starts - s.first[of]).astype(np.int32), pa.int32())], names=["key", "run", "at"])

    return places


class _Articles:
    """Words of articles, given by their blocks: values, codes, the block and article of each word, and where runs inside a block start."""

    def __init__(self, data: np.ndarray, at: np.ndarray, blocks: np.ndarray, run: int):
        words = C.Words(data, at)
        self.values, self.block, self.run = words.hashes(), words.doc, run
        self.codes = np.maximum(self.values >> C.U(48), C.U(1)).astype(np.uint16)
        self.article = np.repeat(np.arange(len(blocks)), blocks)[self.block]
        self.first = np.searchsorted(self.article, np.arange(len(blocks) + 1))
        self.starts = np.flatnonzero(self.block[: max(0, len(self.block) - run + 1)] == self.block[run - 1 :])

    def coded(self) -> list[bytes]:
        """The codes of each article, with a 0 before each block."""
        new = np.diff(self.block, prepend=-1) > 0
        out = np.zeros(len(new) + new.sum(), np.uint16)
        at = np.arange(len(new)) + np.cumsum(new)
        out[at] = self.codes
        cut = np.append(at - new, len(out))[self.first]
        return [out[a:b].tobytes() for a, b in zip(cut, cut[1:])]

    @classmethod
    def of(cls, batches, run: int):
        """Runs of rows of at most CHUNK_BYTES of blocks (a longer row stands alone), and their articles."""
        for batch in batches:
            column = batch.column("blocks")
            counts = column.value_lengths().to_numpy(zero_copy_only=False)
            first = np.cumsum([0, *counts])
            data, at = C.raw(column.flatten())
            size, row = at[first], 0
            while row < batch.num_rows:
                end = max(row + 1, int(np.searchsorted(size, size[row] + C.CHUNK_BYTES, "right")) - 1)
                own = at[first[row] : first[end] + 1]
                yield batch.slice(row, end - row), cls(data[own[0] : own[-1]], own - own[0], counts[row:end], run)
                row = end


def run_hashes(codes: np.ndarray, starts: np.ndarray, run: int) -> np.ndarray:
    return C.span_hash(C.mix(codes.astype(C.U)), starts, starts + run).astype(np.int64)


def _codes(run: int):
    """Articles as codes of two bytes a word: equal runs have equal codes."""

    def codes(batches):
        for batch, a in _Articles.of(batches, run):
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("content"), pa.array(a.coded(), pa.binary())], names=["host", "content", "codes"])

    return codes


def in_most(articles: list[bytes], run: int, at_least: int) -> np.ndarray:
    """Runs of codes in more than half of the articles and in at_least of them, by a suffix array."""
    ids = np.frombuffer(b"".join(articles), np.uint16)
    inside = np.cumsum(np.append(0, ids == 0))
    starts = np.flatnonzero(inside[run:] == inside[:-run]) if len(ids) >= run else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.int64)
    article = np.repeat(np.arange(len(articles)), [len(a) // 2 for a in articles])
    places, n = pages_of(np.unique(suffix_ranks(ids, run)[starts], return_inverse=True)[1], article[starts])
    return run_hashes(ids, np.sort(starts[places[(2 * n > len(articles)) & (n >= at_least)]]), run)


def _common_runs(run: int, at_least: int):
    """Runs of codes in more than half of the distinct articles of a shard; rows are sorted by host, shard and content."""

    def common(batches):
        now = last = None  # host, shard and number of shards; content
        own, size, cut = [], 0, False

        def found():
            whole = now[2] == 1 and not cut  # all articles of the host
            runs = in_most(own, run, at_least if whole else 1) if not whole or len(own) >= at_least else []
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(runs), pa.string()), pa.array(runs, pa.int64())], names=["host", "run"])

        for batch in C.small(batches):
            for *shard, content, codes in zip(*(batch.column(c).to_pylist() for c in ("host", "shard", "shards", "content", "codes")), strict=True):
                if shard != now:
                    if own:
                        yield found()
                    now, last, own, size, cut = shard, None, [], 0, False
                if content == last:
                    continue
                if size > ARRAY_BYTES:
                    cut = True
                    yield found()
                    own, size = [], 0
                last = content
                own.append(codes)
                size += len(codes)
        if own:
            yield found()

    return common


def _common_places(run: int):
    """Runs whose codes are sought on their host, and where they stand in an article, counted in its words."""

    def places(batches):
        for batch, a in _Articles.of(batches, run):
            coded, of = run_hashes(a.codes, a.starts, run), a.article[a.starts]
            first = np.searchsorted(of, np.arange(batch.num_rows + 1))
            sought = batch.column("runs").to_pylist()
            hit = np.flatnonzero(np.concatenate([np.isin(coded[first[i] : first[i + 1]], np.array(r, np.int64)) for i, r in enumerate(sought)]))
            rows, starts = pa.array(of[hit]), a.starts[hit]
            runs = C.span_hash(a.values, starts, starts + run).astype(np.int64)
            at = (starts - a.first[of[hit]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("key", "host", "content")), pa.array(runs, pa.int64()), pa.array(at, pa.int32())], names=["key", "host", "content", "run", "at"])

    return places


def own_text(texts: list[str | None], common: set[int]) -> list[str | None]:
    """The blocks, those of an article empty that common runs cover, if at least half of its words are in others."""
    out, at, left = [], 0, 0
    for t in texts:
        n = len(t.split(" ")) if t else 0
        shared = n > 0 and all(i in common for i in range(at, at + n))
        left += 0 if shared else n
        at += n
        out.append("" if shared else t)
    return out if 2 * left >= at else texts


def main_text(texts: list[str | None], kinds: list[int], boxes: list[int], stream: list[str], gone: set[int], common: set[int] = frozenset()) -> str:
    """The text of a page by its blocks, its stream and the places in it and in its article that repeated runs cover."""
    if common:
        texts = own_text(texts, common)
    words: dict[int, list[tuple[str, bool]]] = {}
    for i, t in enumerate(stream):
        if t.startswith("\t"):
            _, block, word = t.split("\t")
            words.setdefault(int(block), []).append((word, i not in gone))
    unique = {b: sum(u for _, u in ws) for b, ws in words.items()}
    main = [b for b in words if kinds[b] == 1]
    whole = 2 * sum(unique[b] for b in main) >= sum(len(words[b]) for b in main) or not any(unique.values())
    first, last = {}, {}
    for b in words:
        if unique[b]:
            first.setdefault(boxes[b], b)
            last[boxes[b]] = b
    out = []
    for b, t in enumerate(texts):
        if t is None:
            between = first.get(boxes[b], b) < b < last.get(boxes[b], b)
            all_of_it = whole and kinds[b] == 1 or between
            t = " ".join(w for w, u in words[b] if u or all_of_it)
        if t:
            out.append(t)
    return "\n\n".join(out)


def _decide(run: int):
    def decide(batches):
        for batch in C.small(batches):
            out = []
            for texts, kinds, boxes, stream, *found in zip(*(batch.column(c).to_pylist() for c in ("blocks", "kinds", "boxes", "stream", "found", "common")), strict=True):
                out.append(main_text(texts, kinds, boxes, stream.split("\n"), *({i + k for i in at or () for k in range(run)} for at in found)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string())], names=["id", "url", "text"])

    return decide


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", run: int = RUN, min_pages: int = MIN_PAGES, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """id, url, text; a row for each row."""
    spark = C.bounded(pages)
    scratch = C.Scratch(spark, "html")
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), host.alias("host"), F.xxhash64(F.col(page_id).cast("string"), F.lit("\x00"), F.col(url), F.lit("\x00"), F.col(html)).alias("key"), F.col(html).cast("string").alias("html"))
    kind = lambda c: rows.schema[c].dataType.simpleString()
    shape = f"id {kind('id')}, url {kind('url')}, host string, key long, blocks array<string>, kinds array<int>, boxes array<int>, undecided boolean, stream string"
    content = F.when(F.array_contains("kinds", 2), F.xxhash64("blocks"))
    read = scratch.keep(rows.mapInArrow(_read, shape).withColumn("content", content), "read")

    # runs of every host's pages, counted in shards and then over the host
    most = read.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    shard = F.pmod(F.col("key"), F.lit(-(-most // shard_pages) or 1))
    streams = read.select("host", "key", "stream").withColumn("shard", shard).repartition(C.parts(spark), "host", "shard").sortWithinPartitions("host", "shard", "key")
    counted = streams.select("host", "key", "stream").mapInArrow(_count_runs(run), "run long, n long")
    often = scratch.keep(counted.groupBy("run").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_pages), "often")

    found = read.filter("undecided").select("key", "host", "stream").mapInArrow(_places(run), "key long, run long, at int")
    found = C.join_each(found, often, ["run"]).groupBy("key").agg(F.collect_set("at").alias("found"))

    # runs in most articles of a host, sought where a shard has them
    articles = read.filter("content is not null")
    sizes = scratch.keep(articles.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("n")), "sizes")
    large = sizes.filter(F.col("n") > shard_pages).select("host", F.ceil(F.col("n") / shard_pages).alias("shards"))  # fewer than articles / shard_pages
    dealt = articles.select("host", "content", "blocks").mapInArrow(_codes(run), "host string, content long, codes binary").join(F.broadcast(large), "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = dealt.withColumn("shard", F.pmod("content", "shards")).repartition(C.parts(spark), "host", "shard").sortWithinPartitions("host", "shard", "content")
    sought = dealt.mapInArrow(_common_runs(run, min_pages), "host string, run long").groupBy("host").agg(F.collect_set("run").alias("runs"))
    sought = scratch.keep(sought.join(sizes, "host"), "sought")
    places = C.join_each(articles.select("key", "host", "content", "blocks"), sought, ["host"])
    places = scratch.keep(places.mapInArrow(_common_places(run), "key long, host string, content long, run long, at int"), "places")
    most_of = F.col("articles") * 2 > F.col("all")
    common = places.groupBy("host", "run").agg(F.countDistinct("content").alias("articles"), F.count("*").alias("n")).join(sizes.withColumnRenamed("n", "all"), "host")
    common = scratch.keep(common.filter(most_of & (F.col("articles") >= min_pages)).select("host", "run", "n"), "common")
    common = C.join_each(places, common, ["host", "run"]).groupBy("key").agg(F.collect_set("at").alias("common"))

    read = read.join(sought.select("host", F.lit(True).alias("asked")), "host", "left").withColumn("asked", F.col("undecided") | F.col("asked").isNotNull())
    asked = read.filter("asked").withColumn("stream", F.when(F.col("undecided"), F.col("stream")).otherwise(""))  # of use for undecided blocks alone
    judged = asked.join(found, "key", "left").join(common, "key", "left").select("id", "url", "blocks", "kinds", "boxes", "stream", "found", "common")
    out = read.filter("not asked").select("id", "url", F.array_join("blocks", "\n\n").alias("text"))
    return out.unionByName(judged.mapInArrow(_decide(run), f"id {kind('id')}, url {kind('url')}, text string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(C.table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
