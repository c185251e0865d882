"""Main text of web pages, with a suffix array over each host's token streams.

1. Markup becomes blocks: runs of text between block-level tags, character references decoded, white
   space made single. A block knows whether it lies in a part that is never main text (head, scripts,
   styles, menus, headers, footers, sidebars, forms, adverts, notices, reader comments — by tag, role
   or class) and whether in an article or main element.
2. Pages of a host are dealt by a hash into piles of about PILE_BYTES of html, so that a host with a third
   of all pages is many tasks. A pile's token streams are one text, its suffixes are sorted (prefix
   doubling, then the lengths that neighbours share), and substrings of DEPTH words or more that stand on
   REPEATS distinct pages are repeated.
3. Hosts of several piles count across them by the same rule: every page sends hashes of the distinct blocks in its
   article, and, where the host has a page without an article or main element, of all its windows of DEPTH words; a
   shuffled count of distinct pages by host finds those that repeat, and each pile gets back the ones that it holds.
   What is counted is the same in one pile and in many, so a host's texts don't depend on its size (but for two windows
   or blocks of one 64-bit hash).
4. Repetition first: in pages without an article or main element the words that repeated substrings cover go
   and the unique runs stay; in pages with one, whole blocks go that a template puts on most of the host's
   pages (TEMPLATE_SHARE of them, TEMPLATE_PAGES at least). Then markup: blocks in chrome go, and, where there
   is an article or main element, blocks outside it.

Defined cases: null html is the empty page, with empty text; null urls are one host; pages that repeat in
full don't count as evidence against each other (streams are compared by content); an empty table gives no
rows; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, only, slices, stored, whole_text

PILE_BYTES = 1 << 20
DEPTH = 8
#: Distinct pages on which a substring must stand to be boilerplate outside an article.
REPEATS = 3
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.6, 20

# Fixed lists of HTML.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "noembed", "noframes")
CHROME = frozenset("head nav header footer aside form button select menu dialog figure-nav datalist fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: A class or id is chrome if its parts (between - and _) are all from these words, one at least from the first.
CHROME_WORDS = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navs|navbar|navigation|menus?|menubar|breadcrumbs?|sidebars?|widgets?|footers?|headers?|masthead|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|social|share|sharing|related|recommend\w*|comments?|disqus|replies|reply|respond|pagination|pager|search|toolbar|skiplink|copyright|legal", re.I)
CHROME_PARTS = frozenset("site main top bottom left right primary secondary global posts links link list box bar block section area form icons buttons button skip side page message text".split())
#: Words that alone are too weak inside an article.
WEAK = frozenset(("related", "legal"))
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul xmp".split())
#: Elements that may be chrome by name inside an article.
CONTAINERS = frozenset("div section aside ul ol dl nav table form figure details footer header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start tag closes an open one of the same kind.
SELF_CLOSING = {"p": "p", "li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}

TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(!--)|([!?])[^>]*>)")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _chrome_name(value: str, in_main: bool) -> bool:
    for token in value.lower().split():
        parts = [x for x in re.split("[-_]+", token) if x]
        named = [x for x in parts if CHROME_WORDS.fullmatch(x)]
        if named and all(x in named or x in CHROME_PARTS for x in parts) and not (in_main and token in WEAK):
            return True
        if token in ("side-bar", "side_bar", "skip-link", "skip_link"):
            return True
    return False


def _is_chrome(tag: str, attributes: str, in_main: bool) -> int:
    """0: no; 1: a form, which may hold the article; 2: by name or role, which may hold the main element; 3: nothing in it is main text."""
    strength = 0
    if tag in CHROME and not (tag == "header" and in_main):
        strength = 1 if tag in ("form", "fieldset") else 3
    if not attributes or tag in ("html", "body", "article", "main"):
        return strength
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return 3
        if name == "role" and value.lower() in CHROME_ROLES or name in ("class", "id") and (tag in CONTAINERS or not in_main) and _chrome_name(value, in_main):
            strength = max(strength, 2)
    return strength


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, in an article or main element, in chrome) of each block, in page order.

    Forms around the outermost article, and forms and named wrappers around the main element, don't make it chrome.
    """
    out: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, int, bool, int]] = []  # tag, strength of chrome here, main here, chrome elements that it lifts
    chrome = main = lifted = 0
    at, n = 0, len(page)

    def flush() -> None:
        if text:
            line = " ".join(references.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((line, main > 0, chrome > lifted))

    def close(k: int) -> None:
        nonlocal chrome, main, lifted
        while len(stack) > k:
            _, c, m, up = stack.pop()
            chrome, main, lifted = chrome - (c > 0), main - m, lifted - up

    while at < n:
        m = TAG.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        if m[4]:  # a comment ends at --> or with the page
            end = page.find("-->", m.end() - 2)
            at = n if end < 0 else end + 3
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if not m[1] and tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            if tag in BLOCKS:
                flush()
            at = end.end() if end else n
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ("article", "main", "body") and tag in SELF_CLOSING:
                    break
        elif tag not in VOID:
            if tag in SELF_CLOSING:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if stack[k][0] in BLOCKS and stack[k][0] not in SELF_CLOSING:
                        break
            if tag in BLOCKS or m[3] or tag in CHROME:
                is_main = tag in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?(?:main|article)\b", m[3]))
                is_chrome = 0 if is_main else _is_chrome(tag, m[3], main > 0)
                lifts = 0
                if is_main and not main:
                    most = 2 if tag == "main" or re.search(r"role\s*=\s*[\"']?main\b", m[3]) else 1
                    lifts = sum(0 < e[1] <= most for e in stack)
                if not m[3].rstrip().endswith("/") or tag in BLOCKS:
                    stack.append((tag, is_chrome, is_main, lifts))
                    chrome, main, lifted = chrome + (is_chrome > 0), main + is_main, lifted + lifts
    flush()
    return out


def suffix_array(words: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of their suffixes, and how many words each shares with the one before it; a suffix ends with its page.

    Prefix doubling; only suffixes that still have equals are sorted again, and the ranks of every length give the
    shared lengths.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ranked(order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of positions in order: the first place of each one's class, and whether it has equals; new marks a class's first."""
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(order)))
        return np.repeat(starts, sizes), np.repeat(sizes > 1, sizes)

    order = np.argsort(words, kind="stable")
    places, many = ranked(order, np.append(True, words[order][1:] != words[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = places
    levels, size, pending, at = [rank.copy()], 1, order[many], np.flatnonzero(many)
    while len(pending) and size < int((limit - np.arange(n)).max()):
        ahead = np.where(pending + size < limit[pending], rank[np.minimum(pending + size, n - 1)], -1)
        again = np.lexsort((ahead, rank[pending]))
        pending, ahead, own = pending[again], ahead[again], rank[pending][again]
        order[at] = pending
        new = np.append(True, (ahead[1:] != ahead[:-1]) | (own[1:] != own[:-1]))
        places, many = ranked(pending, new)
        rank[pending] = at[places]
        levels.append(rank.copy())
        size *= 2
        pending, at = pending[many], at[many]
    shared = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < limit[order[:-1]]) & (b < limit[order[1:]]))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        a[same] += 1 << k
        b[same] += 1 << k
    shared[1:] = np.minimum(np.minimum(a, limit[order[:-1]]) - order[:-1], np.minimum(b, limit[order[1:]]) - order[1:])
    return order, shared


def repeated(words: np.ndarray, page: np.ndarray, limit: np.ndarray, depth: int) -> np.ndarray:
    """For each position: on how many distinct pages the `depth` words from it stand (0 if its page ends first)."""
    order, shared = suffix_array(words, limit)
    classes = np.cumsum(shared < depth)  # neighbours that share depth words are one class
    whole = order + depth <= limit[order]
    width = int(page.max(initial=0)) + 1
    pairs = np.unique(classes[whole] * width + page[order[whole]])
    pages = np.bincount(pairs // width, minlength=len(words) + 1)
    count = np.zeros(len(words), np.int64)
    count[order[whole]] = pages[classes[whole]]
    return count


def _covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(ends, n), -1)
    return np.cumsum(marks[:-1]) > 0


Blocks = list[tuple[str, bool, bool]]


def _has_main(page: Blocks) -> bool:
    return any(m and not c for _, m, c in page)


def hashed(texts: list[str]) -> np.ndarray:
    """A hash of each text, the same in every task."""
    return pd.util.hash_array(np.array(texts, object), categorize=False).view(np.int64)


def windows(words: list[str], depth: int = DEPTH) -> np.ndarray:
    """A hash of the `depth` words from each position on that has so many."""
    if len(words) < depth:
        return np.zeros(0, np.int64)
    each = hashed(words).view(np.uint64)
    rolled = np.zeros(len(words) - depth + 1, np.uint64)
    for k in range(depth):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + each[k : k + len(rolled)]
    rolled ^= rolled >> np.uint64(29)
    return rolled.view(np.int64)


def block_evidence(pages: list[Blocks]) -> Iterator[tuple[int, bool, np.ndarray]]:
    """For each page: a hash of its content, whether it has a main element, and the hashes of the blocks in it."""
    contents = hashed(["\n".join(line for line, _, _ in one) for one in pages])
    lines = [[line for line, m, c in one if m and not c] for one in pages]
    sent, at = hashed([line for one in lines for line in one]), 0
    for content, main in zip(contents.tolist(), lines, strict=True):
        at += len(main)
        yield content, bool(main), np.unique(sent[at - len(main) : at])


def window_evidence(pages: list[Blocks]) -> Iterator[tuple[int, bool, np.ndarray]]:
    """For each page: a hash of its content, whether it has a main element, and the hashes of its windows."""
    contents = hashed(["\n".join(line for line, _, _ in one) for one in pages])
    for content, one in zip(contents.tolist(), pages, strict=True):
        yield content, _has_main(one), np.unique(windows([w for line, _, _ in one for w in line.split(" ")]))


def clean_pile(pages: list[Blocks], depth: int = DEPTH, repeats: int = REPEATS, share: float = TEMPLATE_SHARE, template_pages: int = TEMPLATE_PAGES,
               known: np.ndarray | None = None) -> list[str]:
    """Main text of each page, judged against the other pages of one host's pile.

    known: hashes of blocks and windows that the host repeats, where it has other piles too; blocks in articles are
    then judged by these alone.
    """
    streams: list[str] = []
    owner, bodies = [], {}
    for blocks_of in pages:
        owner.append(bodies.setdefault("\n".join(b for b, _, _ in blocks_of), len(bodies)))
        for line, _, _ in blocks_of:
            streams += line.split(" ")
    if not streams:
        return ["" for _ in pages]
    sizes = np.array([sum(line.count(" ") + 1 for line, _, _ in p) for p in pages])
    ends, n = np.cumsum(sizes), len(streams)
    ids = pd.factorize(np.array(streams, object))[0].astype(np.int64)
    starts = np.flatnonzero(repeated(ids, np.repeat(np.array(owner), sizes), np.repeat(ends, sizes), depth) >= repeats)
    found = [starts]
    on_pages: dict[str, set[int]] = {}
    if known is None:
        for body, blocks_of in zip(owner, pages, strict=True):
            for line in {line for line, m, c in blocks_of if m and not c}:
                on_pages.setdefault(line, set()).add(body)
        least = max(share * len(bodies), template_pages)
        template = {line for line, on in on_pages.items() if len(on) >= least}
    else:
        lines = list({line for blocks_of in pages for line, m, c in blocks_of if m and not c}) if len(known) else []
        template = {lines[k] for k in np.flatnonzero(np.isin(hashed(lines), known))}
        for end, size, blocks_of in zip(ends.tolist(), sizes.tolist(), pages, strict=True):
            if size and len(known) and not _has_main(blocks_of):
                found.append(np.flatnonzero(np.isin(windows(streams[end - size : end], depth), known)) + end - size)
    starts = np.concatenate(found)
    boiler = _covered(starts, starts + depth, n)
    out, word = [], 0
    for blocks_of in pages:
        has_main, kept = _has_main(blocks_of), []
        for line, in_main, in_chrome in blocks_of:
            at, word = word, word + line.count(" ") + 1
            if has_main:
                if line in template:
                    continue
            elif boiler[at:word].any():
                line = " ".join(x for x, b in zip(line.split(" "), boiler[at:word], strict=True) if not b)
            if line and not in_chrome and (in_main or not has_main):
                kept.append(line)
        out.append("\n".join(kept))
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", pile_bytes: int = PILE_BYTES) -> DataFrame:
    """page_id, url, text for every row."""
    rows = only(pages, page_id=F.col(id_col).cast("long"), url=F.col(url_col), html=whole_text(html_col))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    keyed = rows.withColumn("host", host)
    sizes = stored(keyed.groupBy("host").agg(F.sum(F.octet_length("html")).alias("n")).filter(F.col("n") > pile_bytes), "large-hosts")
    piles = F.coalesce(F.ceil(F.col("n") / F.lit(pile_bytes)), F.lit(1)).cast("long")
    dealt = keyed.join(checked_broadcast(sizes, 64), "host", "left").withColumn("pile", F.pmod(F.xxhash64("page_id", "html"), piles)).withColumn("large", F.col("n").isNotNull()).drop("n")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks as lines of one text, each behind a digit that tells where it lies: parsed once for a shuffle smaller than html."""
        for batch in slices(batches, column=2):
            found = [blocks(h) for h in batch.column(2).to_pylist()]
            texts = ["\n".join(f"{m + 2 * c}{line}" for line, m, c in one) for one in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(3), batch.column(4)], names=["page_id", "url", "blocks", "host", "pile"])

    def unpacked(text: str) -> Blocks:
        return [(line[1:], line[0] in "13", line[0] in "23") for line in text.split("\n")] if text else []

    def send(evidence: Callable[[list[Blocks]], Iterator[tuple[int, bool, np.ndarray]]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hashes of each page, behind a row without one."""
        for batch in slices(batches, column=0):
            keys, contents, plain, hashes = [], [], [], []
            for k, (content, main, mine) in enumerate(evidence([blocks(x) for x in batch.column(0).to_pylist()])):
                keys.append(np.full(len(mine) + 1, k))
                contents.append(np.full(len(mine) + 1, content))
                plain.append(np.full(len(mine) + 1, not main))
                hashes.append(np.concatenate([[0], mine]))
            if keys:
                at = np.concatenate(keys)
                none = np.append(True, at[1:] != at[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array(np.concatenate(contents)), pa.array(np.concatenate(plain)), pa.array(np.concatenate(hashes).astype(np.int64), mask=none)],
                                                 names=["host", "pile", "content", "plain", "hash"])

    def clean(part: pd.DataFrame, known: np.ndarray | None) -> pd.DataFrame:
        return pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": clean_pile([unpacked(b) for b in part["blocks"]], known=known)})

    schema = "page_id long, url string, text string"
    parsed = lambda some: dealt.filter(some).select("page_id", "url", "html", "host", "pile").mapInArrow(parse, "page_id long, url string, blocks string, host string, pile long")
    small = parsed("NOT large").groupBy("host", "pile").applyInPandas(lambda part: clean(part, None), schema)
    if not sizes.count():
        return small

    def gathered(rows: DataFrame, evidence: Callable, name: str) -> DataFrame:
        """host, hash, content of each distinct page, with its piles; content in the key spreads hashes that stand on every page."""
        sent = rows.select("html", "host", "pile").mapInArrow(partial(send, evidence), "host string, pile long, content long, plain boolean, hash long")
        return stored(sent.groupBy("host", "hash", "content").agg(F.collect_set("pile").alias("piles"), F.max("plain").alias("plain")), name)

    def held(apart: DataFrame, repeated: DataFrame, name: str) -> DataFrame:
        """host, pile, hash of the hashes that repeat, for the piles that hold them."""
        hot = stored(repeated.select("host", "hash"), name)
        return apart.join(checked_broadcast(hot, 64), ["host", "hash"]).select("host", F.explode("piles").alias("pile"), "hash").distinct()

    in_blocks = gathered(dealt.filter("large"), block_evidence, "block-evidence")
    # a row without a hash counts the host's distinct pages
    whole = stored(in_blocks.filter("hash IS NULL").groupBy("host").agg(F.count("*").alias("all_pages"), F.max("plain").alias("plain")), "host-pages")
    pages_of = lambda apart: apart.filter("hash IS NOT NULL").groupBy("host", "hash").agg(F.count("*").alias("pages"))
    least = F.greatest(F.col("all_pages") * TEMPLATE_SHARE, F.lit(TEMPLATE_PAGES))
    known = held(in_blocks, pages_of(in_blocks).join(checked_broadcast(whole, 64), "host").filter(F.col("pages") >= least), "block-repeats")
    plain_hosts = stored(whole.filter("plain").select("host"), "plain-hosts")
    if plain_hosts.count():  # windows decide nothing on hosts whose pages all have a main element
        in_windows = gathered(dealt.filter("large").join(checked_broadcast(plain_hosts, 64), "host", "left_semi"), window_evidence, "window-evidence")
        known = known.union(held(in_windows, pages_of(in_windows).filter(F.col("pages") >= REPEATS), "window-repeats"))

    def clean_known(part: pd.DataFrame, hashes: pd.DataFrame) -> pd.DataFrame:
        return clean(part, hashes["hash"].to_numpy(np.int64)) if len(part) else pd.DataFrame({"page_id": [], "url": [], "text": []})

    large = parsed("large").groupBy("host", "pile").cogroup(known.groupBy("host", "pile")).applyInPandas(clean_known, schema)
    return small.unionByName(large)
