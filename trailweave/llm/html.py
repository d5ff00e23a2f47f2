"""Main text of web pages by consensus of their hosts.

Every page is cut into blocks of text, each under a path of containers: tags with their classes, digits left out, so that pages of one
template share paths. A page scores each container path by the prose below it, less what lies in links. Spark sums the scores of all
pages of a host; the path with the most wins, and every page of the host is cut again, keeping the blocks below the winning path. A
page without that path takes its own best. Scores are summed before the shuffle by host and path; pages never meet in one task.

What is boilerplate by its element is dropped. What is so only by words in its class or id is dropped unless it holds most of the page's
prose: then the words name the layout around the main text. Inside an article, names that only contain such a word, or have another
meaning, too (related-work, discussion), say nothing where there are sentences. A title that stands beside the winning container is the text's first block.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, text_slices

#: Winning paths are broadcast while there are at most so many hosts (about 200 bytes each); beyond, pages are joined by host.
BROADCAST_HOSTS = 50_000

# Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br img wbr".split())
DROPPED = frozenset("nav header footer aside form menu dialog button select option input textarea script style noscript template iframe svg math head title object embed applet canvas audio video map xmp noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CONTAINERS = frozenset("html body article main section div td table tbody tr center blockquote td li".split())
#: Words in a class or id that tell boilerplate; of these, words of readers' comments.
BOILERPLATE = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|header|masthead|topbar|footer|foot|sidebar|side|aside|widget\w*|"
    r"comments?|commentlist|respond|replies|disqus|discussion|share\w*|social|sharing|related|recommend\w*|newsletter|subscribe|signup|login|pagination|pager|tags|tagcloud|toolbar|skip|hidden|copyright|legal|disclaimer)(?:$|[_-])",
    re.ASCII | re.IGNORECASE,
)
COMMENTS = re.compile(r"(?:^|[_-])(?:comments?|commentlist|respond|replies|disqus|discussion)(?:$|[_-])", re.ASCII | re.IGNORECASE)
#: Of these, words that name parts of articles as well.
AMBIGUOUS = frozenset("header side aside discussion notice notices legal alert copyright disclaimer tags foot skip".split())
#: Characters of a block that reads as a sentence.
SENTENCE = 40
#: What a container passes on of its score to the one around it: the parts of a text in several containers make up for what is lost from about a sixth on.
PASSED = 0.85
#: Names that say how a page is laid out, not what an element holds.
LAYOUT = re.compile(r"^(?:has|no|with|without|is|hide|show|hides|shows|enable|disable|supports?|js|page|layout|body|site)[_-]|by-side|[_-](?:open|opened|closed|enabled|disabled|fixed|sticky|on|off|visible|layout|active|page)$", re.ASCII | re.IGNORECASE)
#: An element that holds more than this share of a page's prose isn't boilerplate by its name.
MOST = 0.5
#: Names of container paths are kept to about so many characters; the start of a longer one is hashed.
NAME = 400
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WALLS = frozenset("article section div main body table ul ol dl blockquote td th nav aside footer header form".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


def _weak(name: str) -> bool:
    """If a name that holds a word of boilerplate has another meaning as well: it is ambiguous, or a compound with other words."""
    parts = [x for x in re.split(r"[_-]+", name.lower()) if x]
    if len(parts) == 1:
        return parts[0] in AMBIGUOUS
    return not all(BOILERPLATE.fullmatch(x) for x in parts) and not COMMENTS.fullmatch(parts[0])


def _step(tag: str, rest: str) -> tuple[str, bool, list[str]]:
    """A container's part of a path: its tag and classes without digits; if it is boilerplate as an element; the names that say it is."""
    if not rest.strip(" /"):
        return tag, tag in DROPPED, []
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(rest)}
    names = re.sub(r"([a-z])([A-Z])", r"\1-\2", found.get("class", "") + " " + found.get("id", "")).split()
    told = [x for x in names if BOILERPLATE.search(x) and not LAYOUT.search(x)] if tag not in ("html", "body", "article", "main") else []
    hard = tag in DROPPED or found.get("role", "").lower() in _ROLES
    hard = hard or bool(re.search(r"(?:^|[\s\"'])hidden(?:$|[\s=/])", re.sub(r"=\s*(?:\"[^\"]*\"|'[^']*')", "=", rest))) or "display:none" in found.get("style", "").replace(" ", "").lower()
    classes = ".".join(sorted({re.sub(r"\d+", "", x) for x in found.get("class", "").split()} - {""}))
    return (f"{tag}.{classes}" if classes else tag), hard, told


class Page:
    """A page's blocks of text in order, each below a node of the tree of container paths."""

    def __init__(self, page: str) -> None:
        #: Of each node its parent, step and depth; node 0 is the page.
        self.parent, self.step, self.depth = [0], [""], [0]
        #: (node, text, prose: characters less those in links twice, named: the innermost element that is
        #: boilerplate by name, or -1, is it in boilerplate by element?, is it a title?)
        self.blocks: list[tuple[int, str, int, int, bool, bool]] = []
        #: Of each element that is boilerplate by name: the one around it, if it names comments, if it holds a title or the like, if it stands in an article
        #: under names of other meanings, too, and if it is a header that holds a heading.
        self.named: list[list] = []
        self._read(page)
        self.kept = self._kept()

    def _read(self, page: str) -> None:
        children: dict[tuple[int, str], int] = {}
        # tag, node, hard, named element
        stack: list[tuple[str, int, bool, int]] = []
        counts: dict[str, int] = {}
        pieces: list[str] = []
        linked, links, hard = 0, 0, 0

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join(html.unescape("".join(pieces)).split())
                if text:
                    top = stack[-1] if stack else ("", 0, False, -1)
                    self.blocks.append((top[1], text, max(0, len(text) - 2 * linked), top[3], hard > 0, bool(counts.get("h1"))))
                pieces.clear()
            linked = 0

        def close(upto: int) -> None:
            nonlocal hard, links
            while len(stack) > upto:
                tag, _, boiler, _ = stack.pop()
                counts[tag] -= 1
                hard -= boiler
                links -= tag == "a"

        at, n = 0, len(page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                pieces.append(page[at:])
                break
            if lt > at:
                pieces.append(page[at:lt])
                linked += (lt - at) * (links > 0)
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), lt):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            m = _TAG.match(page, lt) or _LOOSE_TAG.match(page, lt)
            if not m:
                if page.startswith("</", lt):  # a bogus comment
                    end = page.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    pieces.append("<")
                    at = lt + 1
                continue
            at, tag, rest = m.end(), m[2].lower(), m[3]
            if tag not in INLINE:
                flush()
            elif tag == "br":
                pieces.append(" ")
            if m[1]:
                if counts.get(tag):
                    upto = len(stack) - 1
                    while stack[upto][0] != tag:
                        upto -= 1
                    # An inline end tag doesn't reach through a block.
                    if tag not in INLINE or all(x[0] in INLINE for x in stack[upto:]):
                        close(upto)
                continue
            if tag in RAW and not rest.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.IGNORECASE).search(page, at)
                at = n if not end else page.find(">", end.start()) + 1 or n
                continue
            if tag in VOID or rest.rstrip().endswith("/") and tag not in CLOSES_P:
                continue
            if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                ends = {"p"} if tag in CLOSES_P else {"td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}.get(tag, {tag})
                if any(counts.get(x) for x in ends):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in ends:
                            close(k)
                            break
                        if stack[k][0] in _WALLS:
                            break
            step, boiler, told = _step(tag, rest)
            by_name = bool(told)
            node, named = (stack[-1][1], stack[-1][3]) if stack else (0, -1)
            if tag in CONTAINERS or (boiler or by_name) and tag not in INLINE:
                if (node, step) not in children:
                    children[node, step] = len(self.parent)
                    self.parent.append(node)
                    self.step.append(step)
                    self.depth.append(self.depth[node] + 1)
                node = children[node, step]
            if tag in ("h1", "main") and named >= 0:
                self.named[named][2] = True
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and named >= 0:
                self.named[named][4] |= self.named[named][5]
            if by_name and not boiler:
                weak = bool(counts.get("article") or counts.get("main")) and all(map(_weak, told))
                self.named.append([named, any(COMMENTS.search(x) for x in told), False, weak, False, any(x.lower() == "header" for x in told)])
                named = len(self.named) - 1
            stack.append((tag, node, boiler, named))
            counts[tag] = counts.get(tag, 0) + 1
            hard += boiler
            links += tag == "a"
        flush()

    def _kept(self) -> list[bool]:
        """Which blocks aren't in boilerplate."""
        prose, size, told = ([0] * len(self.named) for _ in range(3))
        total = 0
        for _, text, own, named, hard, _ in self.blocks:
            total += own * (not hard)
            if named >= 0 and not hard:
                prose[named] += own
                size[named] += len(text)
                told[named] |= own >= SENTENCE and text[-1] in ".!?:;\"')\u201d\u2026"
        for k in range(len(self.named) - 1, -1, -1):
            outer, titled = self.named[k][0], self.named[k][2]
            if outer >= 0:
                prose[outer] += prose[k]
                size[outer] += size[k]
                told[outer] |= told[k]
                self.named[outer][2] |= titled
        dropped = []
        for k, (outer, comments, titled, weak, heads, _) in enumerate(self.named):
            main = prose[k] > MOST * total and (titled or not comments)
            main = main or weak and 2 * prose[k] >= size[k] and bool(told[k] or heads)
            dropped.append(not main or outer >= 0 and dropped[outer])
        return [not hard and (named < 0 or not dropped[named]) for _, _, _, named, hard, _ in self.blocks]

    def names(self) -> list[str]:
        """The name of each node: its steps from the page on; the start of a long one as a hash."""
        out = [""]
        for k in range(1, len(self.parent)):
            start = out[self.parent[k]]
            if len(start) > NAME:
                start = "#" + hashlib.md5(start.encode("utf-8", "surrogatepass")).hexdigest()
            out.append(f"{start}/{self.step[k]}" if start else self.step[k])
        return out

    def scores(self) -> list[float]:
        """The score of each container: its prose, and more so what of it lies right below, so that the closest container wins.

        Elements that name the main text count more; a page's own boilerplate doesn't count.
        """
        sums = [0.0] * len(self.parent)
        for (node, _, prose, _, _, _), kept in zip(self.blocks, self.kept, strict=True):
            sums[node] += prose * kept
        for k in range(len(self.parent) - 1, 0, -1):
            sums[self.parent[k]] += PASSED * sums[k]
        for k in range(1, len(self.parent)):
            tag, _, classes = self.step[k].partition(".")
            sums[k] *= 4.0 if tag in ("article", "main") else 2.0 if re.search(r"article|content|entry|post|story|body-?text|main", classes) else 0.5 if tag in ("html", "body") else 1.0
        return sums

    def below(self, node_name: str | None) -> str | None:
        """The kept blocks below the container of that name, one a line, after titles before it in containers around it; None if there are none."""
        inside = [name == node_name for name in self.names()]
        if node_name is None or not any(inside):
            return None
        around = set()
        for k in (k for k, own in enumerate(inside) if own):
            while k and (k := self.parent[k]) not in around:
                around.add(k)
        for k in range(1, len(inside)):
            inside[k] = inside[k] or inside[self.parent[k]]
        titles, found, titled = [], [], False
        for (node, text, _, _, _, title), kept in zip(self.blocks, self.kept, strict=True):
            if kept and inside[node]:
                found.append(text)
                titled |= title
            elif kept and title and node in around and not found:
                titles.append(text)
        return "\n".join(found if titled else titles + found) if found else None


def extract(page: str | None, consensus: str | None) -> str:
    """The main text of a page: its kept blocks below the consensus path, or below its own best where it has no such path."""
    if not page:
        return ""
    cut_ = Page(page)
    found = cut_.below(consensus)
    if found is None:
        scores, names = cut_.scores()[1:], cut_.names()[1:]
        top = max(scores, default=0.0)
        found = cut_.below(min(n for n, s in zip(names, scores, strict=True) if s == top) if top > 0 else "")
    return found or ""


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def consensus_paths(pages: DataFrame) -> DataFrame:
    """(host, path): of each host the container path with the largest sum of scores; ties to the deeper, then the first in order."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], tuple[float, int]] = {}  # votes, depth
        for batch in batches:
            for part in text_slices(batch, "html"):
                for name, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    if not page:
                        continue
                    cut_ = Page(page)
                    own = cut_.scores()
                    top = max(own[1:], default=0.0)
                    for path, depth, value in zip(cut_.names()[1:], cut_.depth[1:], own[1:], strict=True):
                        if value > 0:
                            # A page has one vote to share, so that long pages don't outvote many others.
                            s, _ = sums.get((name, path), (0.0, 0))
                            sums[name, path] = s + value / top, depth
            if len(sums) > 100_000:
                yield told(sums)
                sums = {}
        if sums:
            yield told(sums)

    def told(sums: dict) -> pa.RecordBatch:
        return pa.record_batch([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums]), pa.array([v[1] for v in sums.values()], pa.int32()), pa.array([round(v[0] * 1e6) for v in sums.values()], pa.int64())], names=["host", "path", "depth", "votes"])

    partial = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, depth int, votes long")
    total = partial.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.max("depth").alias("depth"))
    rank = F.struct("votes", "depth", "path")
    return total.groupBy("host").agg(F.max_by("path", rank).alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    Null or empty html, and pages without text, give an empty text. Pages without a host (a null url, too) vote together as one.
    Repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    winners = cut(consensus_paths(pages).withColumnsRenamed({"host": "of", "path": "consensus"}))
    small = winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    joined = rows.join(F.broadcast(winners) if small else winners, F.col("host") == F.col("of"), "left").select("page_id", "url", "html", "consensus")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html"):
                texts = [extract(page, path) for page, path in zip(part.column("html").to_pylist(), part.column("consensus").to_pylist(), strict=True)]
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(take, "page_id long, url string, text string, n_chars long")
