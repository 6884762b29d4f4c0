"""Main text of web pages by container paths that the pages of a host agree on.

Each page's containers are scored by the text directly in them, less link text; a container passes a part of its score
to the one around it. The best container's path of generalised tags and classes is the page's vote. Spark counts the
votes by host, and the paths with enough of a host's votes are its winning paths. Each page is then extracted again:
the text of all its containers on the best winning path that it has, or of its own best container where it has none.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import in_arrow, text_or_empty, written
from tidewell.operators.joins import small

# HTML element names by their role, and words of class, id and role names.
CONTAINERS = frozenset("html body main article section div td center blockquote figure fieldset details form".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset("nav header footer aside button select datalist dialog menu head noscript object audio video canvas map".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg".split())
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
WHOLE = ("article", "main")  #: what a best container doesn't grow beyond
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE = re.compile(
    r"ads?|adv|adsense|advert\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|signup|login|share\w*|"
    r"sharing|social\w*|sidebar\w*|related\w*|recommend\w*|breadcrumb\w*|nav\w*|menu\w*|masthead|footer\w*|comment\w*|disqus\w*|replies|respond|widget\w*|"
    r"toolbar|pagination|pager|complementary|contentinfo|outbrain|taboola"
)
WEAK_NOISE = re.compile(r"header|head|foot|side|rail|search\w*|notice\w*|alert\w*|toc|skip|copyright|forms?|discussion|reply|responses?")
NEUTRAL = frozenset(
    "site page global top bottom left right box block bar area container wrapper wrap section inner outer slot unit list links link item items group panel region "
    "col column row zone primary secondary desktop mobile sticky fixed the js posts articles stories buttons button icons icon media tabs toggle id".split()
)
PLAIN = frozenset("article articles content contents entry main post story text body prose".split())
NEGATIONS = frozenset("has with without no hide show".split())
GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content\w*|entry|main\w*|post|story\w*|text|body|prose)(?=$|[\s_-])")

TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
PASSED_ON = 0.5
MIN_SHARE = 0.1  #: of a host's votes that a winning path needs


def attributes(rest: str) -> dict[str, str]:
    """Attributes of a tag by lower-cased name, the first of a name; one without a value has an empty one."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), a or b or c)
    return out


def hidden(given: dict[str, str]) -> bool:
    return "hidden" in given and given["hidden"].lower() != "until-found" or given.get("aria-hidden", "").strip().lower() == "true" or bool(NO_DISPLAY.search(given.get("style", "")))


def is_noise(name: str) -> bool:
    """A class or identifier as a whole names something beside the article.

    Its parts, between hyphens and at capitals, are all words of noise, of layout or numbers, with one of noise among them. Words of an
    article may stand beside the clear ones (post-comments), not beside those that articles have, too (post-header).
    """
    parts = [p for p in re.split(r"[-_:]+", CAMEL.sub("-", name).lower()) if p and not p.isdigit()]
    parts = [p.rstrip("0123456789") or p for p in parts]
    if not parts or parts[0] in NEGATIONS:
        return False
    clear = [bool(NOISE.fullmatch(p)) for p in parts]
    weak = [bool(WEAK_NOISE.fullmatch(p)) for p in parts]
    other = [p for p, x, y in zip(parts, clear, weak) if not x and not y and p not in NEUTRAL]
    if any(clear):
        return all(p in PLAIN for p in other)
    return any(weak) and not other


class Page:
    """Blocks of text with the container that each lies in, in page order."""

    def __init__(self, html: str):
        self.paths: list[str] = [""]
        self.parents: list[int] = [-1]
        self.bonus: list[float] = [1.0]
        self.tags: list[str] = [""]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, link characters
        self._read(html)
        self._leave_out_forms()

    def _open(self, parent: int, tag: str, names: str) -> int:
        words = sorted({w for w in re.split(r"[^a-z]+", names) if len(w) > 1})
        self.paths.append(f"{self.paths[parent]}>{tag}" + (f".{'.'.join(words)}" if words else ""))
        self.parents.append(parent)
        self.tags.append(tag)
        self.bonus.append(1.5 if tag in ("article", "main") or GOOD.search(names) else 1.0)
        return len(self.paths) - 1

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool]] = []  # tag, container, left out
        here, out = 0, False
        parts: list[str] = []
        skip = ""  # an element inside a block whose text is left out
        depth = linked = links = 0
        at = 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text:
                    self.blocks.append((here, text, linked))
                parts.clear()
            linked = 0

        def text(piece: str) -> None:
            nonlocal linked
            if piece and not out and not skip:
                parts.append(piece)
                if links:
                    linked += len(piece.strip())

        for m in iter(lambda: TAG.search(html, at), None):
            text(html[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag, closing, rest = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            if tag in RAW and not closing:
                if not rest.endswith("/"):
                    end = ENDS[tag].search(html, at)
                    at = end.start() if end else len(html)
                continue
            if tag in BLOCKS:
                flush()
                links, skip = 0, ""
            elif tag == "br":
                text("\n")
            if closing:
                if skip == tag:
                    depth -= 1
                    if not depth:
                        skip = ""
                elif tag == "a":
                    links = max(0, links - 1)
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        here, out = (stack[-1][1], stack[-1][2]) if stack else (0, False)
                        break
                continue
            if tag in VOID:
                continue
            given = attributes(rest) if rest.strip("/ \t\n\r\f") else {}
            named = " ".join(given[k] for k in ("class", "id", "role") if k in given)
            names = named.lower()
            noise = tag in LEFT_OUT or bool(given) and hidden(given)
            if named and not noise and tag not in ("html", "body") and tag not in HEADINGS:
                noise = given.get("role", "").strip().lower() in ROLES or any(map(is_noise, f"{given.get('class', '')} {given.get('id', '')}".split()))
            if tag in CONTAINERS or tag in LEFT_OUT or (tag in BLOCKS and tag not in ("p", "li", "dt", "dd", "option") and tag not in HEADINGS):
                if tag in CONTAINERS and not out and not noise:
                    here = self._open(here, tag, names)
                out = out or noise
                stack.append((tag, here, out))
            elif skip == tag:
                depth += 1
            elif noise and not skip:
                skip, depth = tag, 1
            elif tag == "a":
                links += 1
        text(html[at:])
        flush()

    def _sums(self) -> list[tuple[int, int]]:
        """Characters and link characters in and below each container."""
        size, linked = [0] * len(self.paths), [0] * len(self.paths)
        for container, text, links in self.blocks:
            size[container] += len(text)
            linked[container] += links
        for i in range(len(size) - 1, 0, -1):  # a container comes after its parent
            size[self.parents[i]] += size[i]
            linked[self.parents[i]] += linked[i]
        return list(zip(size, linked))

    def _leave_out_forms(self) -> None:
        if "form" in self.tags:
            sums, out = self._sums(), [False] * len(self.paths)
            for i in range(1, len(out)):
                out[i] = out[self.parents[i]] or self.tags[i] == "form" and 2 * sums[i][0] <= sums[0][0]
            self.blocks = [b for b in self.blocks if not out[b[0]]]

    def _grown(self, best: int) -> int:
        """The smallest container around `best` with the text-bearing parts beside it; link lists don't count as such.

        Of the page itself only text directly in its body counts, since unmarked containers there can be anything.
        """
        sums, beside = self._sums(), [[] for _ in self.paths]
        for i in range(1, len(self.paths)):
            if sums[i][0]:
                beside[self.parents[i]].append(i)
        own: dict[int, list[tuple[int, int]]] = {}
        for container, text, linked in self.blocks:
            own.setdefault(container, []).append((len(text), linked))
        found = here = best
        while self.tags[here] not in WHOLE and self.parents[here] >= 0:
            before, here = here, self.parents[here]
            parts = own.get(here, [])
            if self.tags[here] not in ("", "html", "body"):
                parts = parts + [sums[i] for i in beside[here] if i != before]
            if any(2 * linked < size for size, linked in parts):
                found = here
            elif parts:
                break
        return found

    def best(self) -> int:
        """The container with the highest score, grown; 0 (the page) without text. The first in page order wins ties."""
        scores = [0.0] * len(self.paths)
        for container, text, linked in self.blocks:
            scores[container] += max(0, len(text) - 2 * linked)
        for i in range(len(scores) - 1, 0, -1):
            if self.parents[i] >= 0:
                scores[self.parents[i]] += PASSED_ON * scores[i]
        ranked = [s * b for s, b in zip(scores, self.bonus)]
        return self._grown(max(range(len(ranked)), key=lambda i: (ranked[i], -i))) if any(ranked) else 0

    def text_of(self, chosen: set[int]) -> str:
        """The blocks in or below the chosen containers."""
        inside = [False] * len(self.paths)
        for i in range(len(inside)):
            inside[i] = i in chosen or (i > 0 and inside[self.parents[i]])
        return "\n\n".join(text for container, text, _ in self.blocks if inside[container])

    def extract(self, winners: list[str]) -> str:
        for path in winners:
            chosen = {i for i, p in enumerate(self.paths) if p == path}
            if chosen and (found := self.text_of(chosen)):
                return found
        return self.text_of({self.best()})


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def votes(df: DataFrame) -> DataFrame:
    """host and path of the best container of every page with text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [Page(h.as_py()) for h in batch.column(1)]
            paths = [p.paths[p.best()] if p.blocks else None for p in pages]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], names=["host", "path"])

    return in_arrow(df.select(host_of(F.col("url")).alias("host"), text_or_empty("html").alias("html")), run, "host string, path string").filter("path is not null")


def winning_paths(voted: DataFrame) -> DataFrame:
    """host and its winning paths, most votes first, ties in the order of the paths; MIN_SHARE bounds their number."""
    counted = written(voted.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes")), "path-votes")
    cast = written(counted.groupBy("host").agg(F.sum("votes").alias("cast")), "host-votes")
    kept = counted.join(cast, "host").filter(F.col("votes") >= MIN_SHARE * F.col("cast"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("minus"), "path")))
    return kept.groupBy("host").agg(ordered.alias("s")).select("host", F.transform("s", lambda x: x["path"]).alias("winners"))


def main_text(df: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of df (page_id, url, html).

    Null html counts as empty; its text is empty, like that of a page without main text. Pages with a null or
    unreadable url vote as one host. Of containers with equal scores the first wins, of paths with equal votes the first in
    the order of their characters. Pages are read whole, however long. Repeated rows stay repeated and vote each; an empty df gives
    an empty result; other columns are ignored. The winning paths are broadcast up to a checked number of hosts, else joined.
    """
    winners = small(written(winning_paths(votes(df)), "winning-paths"))
    pages = df.select(F.col("page_id").cast("long").alias("page_id"), "url", text_or_empty("html").alias("html"), host_of(F.col("url")).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h).extract(w or []) for h, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = in_arrow(pages.join(winners, "host", "left").select("page_id", "url", "html", "winners"), run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
