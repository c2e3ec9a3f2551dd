r"""Main text of web pages by consensus of each host's container paths.

On every page the containers (article, main, section, div, td, body) are measured by the text of all
blocks in them, less what is in links. Where articles and mains hold half of it or more, only text in
them is measured. The page votes for the path of its smallest container with NEARLY all of that text,
lifted to the outermost article or main around it; a path is the chain of all tags with their first
class, digits generalised, kept as a digest. Votes are summed for each host in Spark. Paths with over a
third of the votes of the host's winner, and a twentieth of all, are proven (20 at most). Each page is
extracted again: from its own path if that is proven, or else from the proven path of the most votes
that has text on it, however much more there is elsewhere; from its own only where none has.

What is never text: menus, footers, sidebars, dialogs, scripts and styles, known by tag, what is hidden,
and reader comments, known by tag or name. Page headers, forms, notices, adverts and other parts that are
named by class, id or role are suspects: a name counts if all its parts are words of that kind or of page
parts ("ad", "cookie-notice", "main-navigation", but not "has-sidebar"); for comments one word is enough,
unless another says that there are none or that they are only counted ("no-comments"). A suspect around an
article or main is none, nor is one that holds MOST of the text of a page without these; one that page parts
or a single word made suspect is none if it holds MOST of its article (comments: all of it).

Hosts teach noise beside names: each page also tells the groups (div, section, lists, tables) at each path
that are not around its own container, with a digest of their text and how much of it is in links. A path
is noise on a host if over SEEN distinct pages or more it has each text SEEN times on average, or if it has
a class and most of its text is in links. Noise is taken out of what a page is extracted from, unless that
would take MOST of it. Copies of a page count once.

Every page is read once, from front to end, in time that grows with its length. A quote that is never
closed does not hide what follows: from there on tags end at the next >. Defined results: a null, empty
or textless page gives an empty text; unclosed and stray tags are closed as browsers do for blocks; a
tag, comment or script that never ends goes up to the page's end; text outside all tags belongs to the
body; a null url is a host of its own; repeated rows vote and are extracted each; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fonoteca.llm import common

# Fixed values.
NEARLY = 0.9
CONTAINERS = frozenset("article main section div td body".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
MOST = 0.8
SKIPPED = frozenset("aside button datalist dialog footer head input menu nav noscript object option select svg template".split())
SUSPECTS = frozenset("form header".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
NOISE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs alert alerts adsbygoogle adsense consent cookie cookies footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popular popup promo promoted recommended recommendations related search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe toolbar trending widget widgets".split()
)
#: Parts of names that say nothing by themselves.
NEUTRAL = frozenset("area bar block bottom box buttons container global header icons inner item left links list panel posts primary right row secondary section site slot text thread top unit wrap wrapper".split())
#: Words of page parts, which say nothing beside words of noise either.
PARTS = NEUTRAL | frozenset("article blog body box content entry fb feed form legal main most page post reader site story user users website".split())
#: With these a name tells of comments that are elsewhere, or of none.
FLAGS = frozenset("allow allowed closed count counter disabled enabled has hide icon link no number off on open show toggle with without".split())
MOST_READ = re.compile(r"most-?_?(?:commented|popular|read|shared|viewed)")
ARTICLE_NOISE = COMMENT_WORDS | frozenset("ad ads advert promo related sponsored".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Elements whose content is no markup.
RAW = {tag: re.compile(rf"</{tag}(?![a-z0-9])", re.I) for tag in ("script", "style", "textarea", "title", "iframe", "xmp")}
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|for)\s*+(?:=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: A start of the left tag ends an open element of the right ones, no further up than a container.
ENDS_P = BLOCKS - {"br", "html", "body", "head", "title", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Closing tags and new blocks end nothing beyond the nearest of these.
SCOPES = CONTAINERS | {"ul", "ol", "dl", "table", "blockquote"}
WORDS = re.compile(r"[a-z]+")
#: Elements of which hosts learn whether they are noise, and from how many pages.
GROUPS = frozenset("div section ul ol dl table".split())
SEEN = 4
PRIME, BASE = (1 << 61) - 1, 1_000_003


def says(names: list[str], words: frozenset[str], beside: frozenset[str] = NEUTRAL) -> bool:
    """Whether a name consists of these words, of neutral ones beside them, and of digits."""
    for name in names:
        parts = set(WORDS.findall(name))
        if parts & words and parts <= words | beside:
            return True
    return False


def of_comments(names: list[str]) -> bool:
    """Whether a name has a word for comments anywhere, and none that says they are elsewhere."""
    for name in names:
        parts = WORDS.findall(name)
        if any(part.endswith(("comment", "comments")) or part == "disqus" for part in parts) and FLAGS.isdisjoint(parts):
            return True
    return False


class Node:
    __slots__ = ("tag", "path", "parent", "skipped", "inside", "link", "suspect", "holds", "drop", "first", "last", "open", "main", "soft", "around", "named")

    def __init__(self, tag: str, path: str, parent: Node | None, skipped: bool, inside: bool, link: bool, first: int):
        self.tag, self.path, self.parent, self.skipped, self.inside, self.link = tag, path, parent, skipped, inside, link
        self.first, self.last = first, None
        self.suspect: Node | None = parent.suspect if parent else None
        self.holds = self.drop = self.around = self.named = False
        #: The nearest article or main, and why the element is a suspect, if not by a plain name.
        self.main: Node | None = self if tag in ("article", "main") else parent.main if parent else None
        self.soft = ""
        #: Of a scope, how many elements of each tag are open in it.
        self.open: dict[str, int] = {}


class Page:
    """The blocks of a page and its containers; a container holds the blocks first to last."""

    def __init__(self, source: str):
        self.blocks: list[tuple[Node, str]] = []
        self.scores: list[float] = []
        self.links: list[int] = []
        self.containers: list[Node] = []
        self.groups: list[Node] = []
        self.suspects: list[Node] = []
        self.stack = [Node("", "", None, False, False, False, 0)]
        self.scopes = [self.stack[0]]
        self.open_tags: dict[str, int] = {}
        self.pieces: list[str] = []
        self.linked = 0
        self.root = self.stack[0]
        self.containers.append(self.root)
        self.read(source)
        self.flush()
        for node in self.stack:
            node.last = len(self.blocks)
        self.judge()

    def read(self, source: str) -> None:
        at, find, size, quotes = 0, source.find, len(source), True
        while (begin := find("<", at)) >= 0:
            name = NAME.match(source, begin)
            if not name and source[begin + 1 : begin + 2] not in ("!", "?"):
                self.text(source[at : begin + 1])
                at = begin + 1
                continue
            self.text(source[at:begin])
            if not name:
                comment = source.startswith("<!--", begin)
                end = find("-->" if comment else ">", begin + 2)
                at = size if end < 0 else end + (3 if comment else 1)
                continue
            end, k = -1, name.end()
            while quotes and (stop := STOP.search(source, k)):
                if stop[0] == ">":
                    end = stop.start()
                    break
                k = find(stop[0], stop.end()) + 1
                if not k:
                    quotes = False
            if end < 0:
                quotes = quotes and find(">", name.end()) < 0
                end = find(">", name.end())
            tag = name[1].lower()
            if end < 0:
                return
            at = end + 1
            if source[begin + 1] == "/":
                self.close(tag)
                continue
            self.open(tag, source[name.end() : end])
            if tag in RAW:
                closing = RAW[tag].search(source, at)
                if not closing:
                    return
                end = find(">", closing.start())
                at = size if end < 0 else end + 1
        self.text(source[at:])

    def text(self, piece: str) -> None:
        if piece and not self.stack[-1].skipped:
            piece = html.unescape(piece) if "&" in piece else piece
            self.pieces.append(piece)
            if self.stack[-1].link:
                self.linked += len(piece)

    def flush(self) -> None:
        """Ends a block: its text goes to the blocks, its score to the scores."""
        if not self.pieces:
            return
        text = " ".join("".join(self.pieces).split())
        linked, self.pieces, self.linked = self.linked, [], 0
        if not text:
            return
        self.blocks.append((self.stack[-1], text))
        self.links.append(min(linked, len(text)))
        self.scores.append(max(0.0, len(text) - 2.0 * linked) * (1.0 if len(text) > 40 or text[-1] in ".!?" else 0.3))

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
            if tag in ENDS_P:
                self.end({"p"})
            if tag in SIBLINGS:
                self.end(SIBLINGS[tag])
            if tag[0] == "h" and tag[1:].isdigit():
                self.end({"h1", "h2", "h3", "h4", "h5", "h6"})
        if tag in VOID or tag in RAW:
            return
        above = self.stack[-1]
        found = {name.lower(): (a or b or c or "").lower() for name, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
        names = found.get("class", "").split()
        step = tag + ("." + re.sub(r"\d+", "#", names[0]) if names else "")
        marked = tag in ("article", "main")
        named = [*names, *found.get("id", "").split()]
        comment = tag not in ("body", "html", "main") and says(named, COMMENT_WORDS)
        skipped = above.skipped or tag in SKIPPED or comment or "hidden" in found or found.get("aria-hidden") == "true" or tag == "label" and "for" in found
        path = hashlib.blake2b(f"{above.path}/{step}".encode("utf-8", "replace"), digest_size=8).hexdigest()
        node = Node(tag, path, above, skipped, above.inside or marked, above.link or tag == "a", len(self.blocks))
        node.named = bool(names)
        whole = tag in ("body", "html", "main")
        if tag in SUSPECTS and not (tag == "header" and above.inside) or not whole and (says(named, ARTICLE_NOISE if marked else NOISE_WORDS) or found.get("role") in ROLES):
            node.suspect = node
            self.suspects.append(node)
        elif named and not whole and not marked and (loose := "comment" if of_comments(named) else "part" if says(named, NOISE_WORDS, PARTS) or any(map(MOST_READ.match, named)) else ""):
            node.suspect, node.soft = node, loose
            self.suspects.append(node)
        elif marked and not skipped:
            held = node.suspect
            while held is not None and not held.holds:
                held.holds, held = True, held.parent.suspect
        self.stack.append(node)
        scope = self.scopes[-1].open
        scope[tag] = scope.get(tag, 0) + 1
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        if tag in SCOPES:
            self.scopes.append(node)
        if tag in CONTAINERS and not skipped:
            self.containers.append(node)
        if tag in GROUPS and not skipped:
            self.groups.append(node)
        if marked and not skipped:
            while above is not None and not above.around:
                above.around, above = True, above.parent

    def end(self, tags: set[str]) -> None:
        """Closes the nearest open element of these tags, if it is in the nearest scope or is that scope."""
        scope = self.scopes[-1]
        if scope.tag in tags or any(scope.open.get(tag) for tag in tags):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in tags:
                    self.pop(k)
                    return

    def close(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        scope = self.scopes[-1]
        if self.open_tags.get(tag) and (tag in BLOCKS or tag == scope.tag or scope.open.get(tag)):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag:
                    self.pop(k)
                    return

    def pop(self, k: int) -> None:
        for node in reversed(self.stack[k:]):
            node.last = len(self.blocks)
            if self.scopes[-1] is node:
                self.scopes.pop()
            self.scopes[-1].open[node.tag] -= 1
            self.open_tags[node.tag] -= 1
        del self.stack[k:]

    def judge(self) -> None:
        """Takes out the blocks of suspects, but for those around an article or main, or around most of a page without."""
        if not self.suspects:
            return
        sums = [0.0, *accumulate(self.scores)]
        free = any(node.tag in ("article", "main") and (node.suspect is None or node.suspect.holds) and node.first < node.last for node in self.containers)
        for node in self.suspects:  # the outer ones come first
            outer, own = node.parent.suspect, sums[node.last] - sums[node.first]
            around = node.main if node.soft and node.main else None
            all_of = sums[around.last] - sums[around.first] if around else sums[-1]
            kept = node.holds or (around or not free) and (own >= all_of if node.soft == "comment" else own > MOST * all_of)
            node.drop = not kept or outer is not None and outer.drop
        keep = [node.suspect is None or not node.suspect.drop for node, _ in self.blocks]
        if all(keep):
            return
        place = [0, *accumulate(keep)]
        self.blocks = [block for block, stays in zip(self.blocks, keep) if stays]
        self.scores = [score for score, stays in zip(self.scores, keep) if stays]
        self.links = [linked for linked, stays in zip(self.links, keep) if stays]
        self.containers = [node for node in self.containers if node.suspect is None or not node.suspect.drop]
        self.groups = [node for node in self.groups if node.suspect is None or not node.suspect.drop]
        for node in dict.fromkeys([*self.containers, *self.groups]):
            node.first, node.last = place[node.first], place[node.last]

    def best(self) -> Node:
        """The smallest container that holds nearly all text, or the outermost article or main around it."""
        marked, end = [0.0] * len(self.scores), 0
        for node in self.containers:
            if node.tag in ("article", "main") and node.last > end:
                begin, end = max(node.first, end), node.last
                marked[begin:end] = self.scores[begin:end]
        sums = [0.0, *accumulate(marked if 2 * sum(marked) >= sum(self.scores) else self.scores)]
        if not sums[-1]:
            return self.root
        found = lifted = [node for node in self.containers if sums[node.last] - sums[node.first] >= NEARLY * sums[-1]][-1]
        while found is not None:
            lifted = found if found.tag in ("article", "main") else lifted
            found = found.parent
        return lifted

    @staticmethod
    def above(nodes: list[Node]) -> set[Node]:
        """These nodes and all around them."""
        found: set[Node] = set()
        for node in nodes:
            up: Node | None = node
            while up is not None and up not in found:
                found.add(up)
                up = up.parent
        return found

    def vote(self) -> tuple[str, int, list[dict]]:
        """The path the page votes for, a digest of its text, and (path, digest, linked, chars) of its groups that are not around that."""
        best, power = self.best(), [1]
        digests = [0]
        for _, text in self.blocks:
            value = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=7).digest(), "little")
            digests.append((digests[-1] * BASE + value + 1) % PRIME)
            power.append(power[-1] * BASE % PRIME)
        linked = [0, *accumulate(self.links)]
        chars = [0, *accumulate(len(text) for _, text in self.blocks)]
        parts: dict[str, list] = {}
        outside = self.above([best])
        for node in self.groups:
            if node.first == node.last or node.around or node in outside:
                continue
            own = (digests[node.last] - digests[node.first] * power[node.last - node.first]) % PRIME
            part = parts.setdefault(node.path, [0, 0, 0, node.named])
            part[0] = (part[0] * BASE + own + 1) % PRIME
            part[1] += linked[node.last] - linked[node.first]
            part[2] += chars[node.last] - chars[node.first]
        found = [{"path": path, "digest": digest, "linked": in_links if named else 0, "chars": n} for path, (digest, in_links, n, named) in parts.items()]
        return best.path, digests[-1], found

    def extract(self, proven: list[str] | None, noise: frozenset[str] = frozenset()) -> str:
        """The text of the page's own container, or of the first proven path with text if its own is not proven, without noise."""
        best, sums = self.best(), [0.0, *accumulate(self.scores)]
        chosen = [best]
        for path in (best.path,) if best.path in (proven or ()) else proven or ():
            there = [node for node in self.containers if node.path == path]
            if any(sums[node.last] > sums[node.first] for node in there):
                chosen = there
                break
        taken = sorted({i for node in chosen for i in range(node.first, node.last)})
        if noise:
            outside, depth = self.above(chosen), [0] * (len(self.blocks) + 1)
            for node in self.groups:
                if node.path in noise and not node.around and node not in outside:
                    depth[node.first] += 1
                    depth[node.last] -= 1
            hidden = list(accumulate(depth))
            left = [i for i in taken if not hidden[i]]
            if sum(self.scores[i] for i in left) >= (1 - MOST) * sum(self.scores[i] for i in taken):
                taken = left
        return "\n".join(self.blocks[i][1] for i in taken)


def host_of(url: str) -> F.Column:
    """The host in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def ballots(pages: DataFrame, html_col: str) -> DataFrame:
    """(__host, path, page, parts) of every page: its vote and what its groups hold."""

    def make():
        def of(sources: list[bytes]) -> list[list]:
            return [list(column) for column in zip(*(Page(s.decode("utf-8", "replace")).vote() for s in sources))]

        return of

    return common.map_texts(pages, html_col, ["__host"], "path string, page long, parts array<struct<path string, digest long, linked long, chars long>>", make)


def votes_of(cast: DataFrame) -> DataFrame:
    return cast.groupBy("__host", "path").agg(F.count("*").alias("vote"))


def winners(pages: DataFrame, html_col: str) -> DataFrame:
    """(host, path): for each host the path of the most votes, of equals the first in order."""
    return votes_of(ballots(pages, html_col)).groupBy("__host").agg(F.min_by("path", F.struct(-F.col("vote"), F.col("path"))).alias("__path"))


def learned(pages: DataFrame, html_col: str) -> DataFrame:
    """(__host, __proven, __noise): for each host its proven paths in order of votes, and its paths of noise, comma-joined."""
    cast = common.materialise(ballots(pages, html_col))
    votes = votes_of(cast)
    of_host = votes.groupBy("__host").agg(F.max("vote").alias("top"), F.sum("vote").alias("total"))
    fit = votes.join(of_host, "__host").where("vote * 3 > top AND vote * 20 >= total")
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("vote")).alias("vote"), "path")))
    proven = fit.groupBy("__host").agg(F.concat_ws(",", F.transform(in_order, lambda x: x["path"])).alias("__proven"))
    part = cast.select("__host", "page", F.explode("parts").alias("part")).select("__host", "page", "part.*")
    once = part.groupBy("__host", "path", "digest", "page").agg(F.max("linked").alias("linked"), F.max("chars").alias("chars"))
    texts = once.groupBy("__host", "path", "digest").agg(F.count("*").alias("n"), F.sum("linked").alias("linked"), F.sum("chars").alias("chars"))
    seen = texts.groupBy("__host", "path").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.sum("linked").alias("linked"), F.sum("chars").alias("chars"))
    bad = seen.where(f"n >= {SEEN} AND (texts * {SEEN} <= n OR linked * 2 > chars)")
    noise = bad.groupBy("__host").agg(F.concat_ws(",", F.array_sort(F.collect_list("path"))).alias("__noise"))
    return of_host.select("__host").join(proven, "__host", "left").join(noise, "__host", "left").na.fill("")


#: Winning paths of up to this size are sent to every task; beyond it they are joined, hot hosts salted.
BROADCAST_BYTES, SALTS = 4 << 20, 16


def extract(pages: DataFrame, keep: list[str] | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns keep (page_id and the url if not given), text and n_chars of every page."""
    keep = list(dict.fromkeys(keep or ["page_id", url_col]))
    pages = pages.select(F.struct(*keep).alias("kept"), host_of(F.col(url_col)).alias("__host"), F.col(html_col).alias("__html"))
    known = common.materialise(learned(pages, "__html"))
    size = known.agg(F.sum(F.length("__host") + F.length("__proven") + F.length("__noise") + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        placed = pages.join(F.broadcast(known), "__host", "left")
    else:
        known = known.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = pages.withColumn("__salt", F.pmod(F.xxhash64("__html"), F.lit(SALTS)).cast("int"))
        placed = salted.join(known, ["__host", "__salt"], "left")
    text_of = [F.coalesce(F.col(c), F.lit("")) for c in ("__proven", "__noise", "__html")]
    packed = placed.select("kept", F.concat_ws("\0", *text_of).alias("__page"))

    def make():
        def of(sources: list[bytes]) -> list[list]:
            texts = []
            for source in sources:
                proven, noise, text = source.decode("utf-8", "replace").split("\0", 2)
                texts.append(Page(text).extract(proven.split(",") if proven else None, frozenset(noise.split(",")) if noise else frozenset()))
            return [texts, [len(t) for t in texts]]

        return of

    return common.map_texts(packed, "__page", ["kept"], "text string, n_chars long", make).select("kept.*", "text", "n_chars")


def paths(sources: Iterator[str]) -> Iterator[str]:
    """The best container's path of each page."""
    return (Page(s).best().path for s in sources)
