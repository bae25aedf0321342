"""Main text of web pages by tree scoring."""

from __future__ import annotations

import collections
import html as htmllib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, unused

ship(__name__)

#: Elements without an end tag; those whose content is text; those of a head; those left out; those that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
HEAD = frozenset("base link meta noscript script style template title".split())
SKIP = frozenset("head script style noscript iframe template nav header footer aside form button select textarea input svg canvas object audio video menu dialog".split())
BLOCK = frozenset("address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Class and id names of furniture, and words that may stand beside those in one name, as in site-footer.
UNWANTED = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice alert popup modal newsletter subscribe signup sidebar widget nav navbar navigation menu breadcrumb breadcrumbs header masthead footer copyright comment comments disqus respond reply replies share sharing social related recommended".split())
BESIDE = frozenset("a area bar block bottom box buttons container form icons item left links list main page panel right section site slot thread top wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Words of class and id names beside a post's author and time.
MARKS = frozenset("author avatar byline user username nick posted timestamp date datetime time ago".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A text of fewer characters is short; one of as many outside links may be a paragraph of the article.
SHORT, PARAGRAPH = 200, 80
#: Signs that make a container furniture if its name is a hint, and if not.
SIGNS, SIGNS_UNNAMED = 1, 3
#: A sibling of the article's containers is furniture if this share of its text or more is in links.
LINKED = 0.5

NAME = re.compile(r"[A-Za-z][^\s/>]*")
PLAIN_NAME = re.compile(r"[A-Za-z][^\s/<>]*")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ATTR_NAME = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)?")
EQUALS = re.compile(r"\s*=\s*")
UNQUOTED = re.compile(r"[^\s>]*")
PLAIN_TAG = re.compile(r"[^<>]*>")
SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "up", "parts", "score", "text", "linked", "skip", "block", "form", "hint", "mark", "kind")

    def __init__(self, tag: str, up: Element | None, skip: bool = False, attrs: dict[str, str] | None = None):
        self.tag, self.up, self.skip = tag, up, skip
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}" if attrs else ""
        words = {w.lower() for w in NAME_WORD.findall(names)} if names != " " else set()
        #: Whether a name has a word of furniture; whether it is an author's or a time; what makes siblings alike.
        self.hint = not words.isdisjoint(UNWANTED) or any(w.startswith("adsby") for w in words)
        self.mark = tag == "time" or not words.isdisjoint(MARKS)
        self.kind = (tag, attrs.get("class", "")) if attrs else (tag, "")
        #: The nearest block and form that the element is or lies in.
        self.block: Element | None = self if tag in BLOCK else up and up.block
        self.form: Element | None = self if tag == "form" else up and up.form
        self.parts: list[Element | str] = []
        self.score, self.text, self.linked = 0.0, 0, 0


def furniture(names: str) -> bool:
    """Whether one of the class or id names is UNWANTED, alone or together with BESIDE words and numbers."""
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_\d]+", name) if w]
        if any(w in UNWANTED for w in words) and all(w in UNWANTED or w in BESIDE for w in words):
            return True
    return False


def unwanted(tag: str, attrs: dict[str, str]) -> bool:
    if tag in SKIP:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    role = attrs.get("role", "").lower().strip()
    if "hidden" in attrs or HIDDEN.search(attrs.get("style", "")) or attrs.get("aria-hidden", "").lower() == "true" or role in ROLES:
        return True
    return furniture(attrs.get("class", "")) or furniture(attrs.get("id", ""))


class Scanner:
    """Reads tags from left to right, each character once: a tag without its > makes all later ones end at the next < or >."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'>"}
        self.strict = True

    def name(self, at: int) -> re.Match | None:
        """A tag's name at this place, if a > follows at all; once a tag hasn't ended, names end at < too."""
        return (NAME if self.strict else PLAIN_NAME).match(self.page, at) if at < self.last[">"] else None

    def attributes(self, at: int) -> tuple[int, dict[str, str], bool] | None:
        """The place after a tag's >, its attributes by name (the first of a name counts) and whether a slash ends it."""
        page, out = self.page, {}
        while True:
            m = ATTR_NAME.match(page, at)
            at, name = m.end(), m[1]
            if at >= len(page):
                return None
            if name is None:  # at >
                return at + 1, out, page[at - 1] == "/"
            value = ""
            if e := EQUALS.match(page, at):
                at = e.end()
                q = page[at : at + 1]
                if q in self.last and q and self.last[q] > at:
                    end = page.index(q, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    v = UNQUOTED.match(page, at)
                    value, at = v[0], v.end()
            out.setdefault(name.lower(), htmllib.unescape(value))

    def tag(self, at: int) -> tuple[int, dict[str, str], bool] | None:
        """Like attributes, from the end of a tag's name; None where no tag ends."""
        if self.strict:
            if found := self.attributes(at):
                return found
            self.strict = False
        m = PLAIN_TAG.match(self.page, at)
        return (m.end(), {}, m[0].endswith("/>")) if m else None


def parsed(page: str) -> Element:
    """The tree of a page. End tags close up to their element if it is open; p, li, dt and dd close an open one of their kind.

    A head ends where something stands that can't be in it, comments end with the page at the latest, and a < that
    opens no tag is text. A form around an article or main element is a container like others.
    """
    root = now = Element("#root", None)
    scan = Scanner(page)
    at = text_from = 0
    head: Element | None = None
    closers: dict[str, re.Pattern] = {}
    opened: collections.Counter[str] = collections.Counter()

    def leave(upto: Element) -> None:
        """Close all open elements up to this one, which stays open."""
        nonlocal now
        while now is not upto:
            opened[now.tag] -= 1
            now = now.up

    def add(upto: int) -> None:
        nonlocal head
        if upto > text_from:
            text = htmllib.unescape(page[text_from:upto])
            if head and now is head and text.strip():
                leave(head.up)
                head = None
            now.parts.append(text)

    while (at := page.find("<", at)) >= 0:
        start = at
        if page.startswith("<!--", at):
            add(start)
            end = page.find("-->", at + 2)
            at = text_from = end + 3 if end >= 0 else len(page)
            continue
        if page[at + 1 : at + 2] in ("!", "?") and page[at + 1 : at + 2]:
            end = page.find(">", at)
            if end < 0:
                break
            add(start)
            at = text_from = end + 1
            continue
        closing = page.startswith("/", at + 1)
        m = scan.name(at + 1 + closing)
        found = scan.tag(m.end()) if m else None
        if not found:
            at += 1
            continue
        add(start)
        end, attrs, empty = found
        at = text_from = end
        tag = m[0].lower()
        if closing:
            if opened[tag] > 0:
                while now.tag != tag:
                    leave(now.up)
                leave(now.up)
            if tag == "head":
                head = None
            continue
        if head and tag not in HEAD:
            leave(head.up)
            head = None
        if tag in BLOCK and (node := now.block) and (node.tag == "p" and tag != "br" or node.tag == tag in ("li", "dt", "dd")):
            leave(node.up)
        child = Element(tag, now, unwanted(tag, attrs), attrs)
        now.parts.append(child)
        if tag in ("article", "main"):
            form = child.form
            while form and form.skip:  # a form that was freed has freed those around it
                form.skip, form = False, form.up.form
        if tag in RAW:
            closer = closers.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I))
            stop = closer.search(page, at)
            if not child.skip:
                child.parts.append(htmllib.unescape(page[at : stop.start() if stop else len(page)]))
            at = text_from = stop.end() if stop else len(page)
        elif tag not in VOID and not empty:
            now = child
            opened[tag] += 1
            if tag == "head":
                head = child
    add(len(page))
    return root


def blocks(node: Element) -> list[tuple[Element, str, int]]:
    """The runs of text between block boundaries in page order: innermost block element, text, characters in links."""
    out: list[tuple[Element, str, int]] = []
    run: list[str] = []
    links = 0

    def flush(owner: Element) -> None:
        nonlocal run, links
        if text := SPACE.sub(" ", "".join(run)).strip():
            out.append((owner, text, links))
        run, links = [], 0

    stack: list[tuple[Element, Element, bool, Iterator]] = [(node, node, False, iter(node.parts))]
    while stack:
        element, owner, in_link, rest = stack[-1]
        for part in rest:
            if isinstance(part, str):
                run.append(part)
                if in_link:
                    links += len(part.strip())
            elif part.skip:
                if part.tag in BLOCK or part.tag in SKIP:
                    flush(owner)
                continue
            elif part.tag == "br":
                run.append(" ")
            else:
                block = part.tag in BLOCK
                if block:
                    flush(owner)
                stack.append((part, part if block else owner, in_link or part.tag == "a", iter(part.parts)))
                break
        else:
            stack.pop()
            if element is owner:
                flush(owner)
    return out


def totals(root: Element, found: list[tuple[Element, str, int]]) -> None:
    """Set each element's characters of text, and those in links, with all that lies in it."""
    for owner, text, links in found:
        owner.text += len(text)
        owner.linked += links
    order, at = [root], 0
    while at < len(order):
        order += [p for p in order[at].parts if isinstance(p, Element) and not p.skip]
        at += 1
    for e in reversed(order[1:]):
        e.up.text += e.text
        e.up.linked += e.linked


def anywhere(element: Element | None, is_so, known: dict[int, bool]) -> bool:
    """Whether something holds of the element or of one around it; known keeps the answers."""
    way = []
    while element is not None and id(element) not in known:
        way.append(element)
        element = element.up
    answer = known[id(element)] if element is not None else False
    for e in reversed(way):
        answer = known[id(e)] = answer or is_so(e)
    return answer


def attached(root: Element, found: list[tuple[Element, str, int]], on_way: set[int]) -> set[int]:
    """Ids of containers that don't hold the best one and are reader comments, adverts, notices or lists of other pages.

    Signs: it stands after the article's last paragraph, has siblings of its kind, holds an author or time, or is half in
    links; for one whose name is a hint, that it is short. Such a name calls for one sign, no name for three. Nothing goes
    that has as much text as all that isn't in question.
    """
    order, at = [root], 0
    while at < len(order):
        order += [p for p in order[at].parts if isinstance(p, Element) and not p.skip]
        at += 1
    marks: set[int] = set()
    for e in reversed(order):
        if e.mark or id(e) in marks:
            marks |= {id(e)} | ({id(e.up)} if e.up is not None else set())
    alike: dict[tuple, list[Element]] = {}
    for e in order:
        if e.tag in BLOCK and e.text and e.up is not None:
            alike.setdefault((id(e.up), e.kind, id(e) in marks), []).append(e)
    family = lambda e: alike.get((id(e.up), e.kind, id(e) in marks), [e])
    twins = lambda e: len(family(e)) > 1
    asked = {id(e): e for e in order if e.text and id(e) not in on_way and (e.hint or twins(e) and id(e) in marks)}
    inside: dict[int, bool] = {}
    free = [i for i, (owner, _, _) in enumerate(found) if not anywhere(owner, lambda e: id(e) in asked, inside)]
    most = sum(len(found[i][1]) for i in free)
    last = max((i for i in free if len(found[i][1]) - found[i][2] >= PARAGRAPH), default=-1)
    first: dict[int, int] = {}
    for i, (owner, _, _) in enumerate(found):
        while owner is not None and id(owner) not in first:
            first[id(owner)] = i
            owner = owner.up
    out = set()
    size = {k: sum(x.text for x in family(e)) for k, e in asked.items()}
    for k, e in asked.items():
        signs = (first[k] > last >= 0) + twins(e) + (k in marks) + (e.linked >= LINKED * e.text) + (e.hint and e.text < SHORT)
        if size[k] < most and signs >= (SIGNS if e.hint else SIGNS_UNNAMED):
            out.add(k)
    return out


def scored(found: list[tuple[Element, str, int]]) -> Element:
    """The container with the most points; totals() has been set.

    Each run of text between block boundaries gives 1 point, 1 for each comma and 1 for each 100 characters,
    times the share of it outside links: in full to its container, a half to the next one up, a third to the
    one above. Containers lose the share of their text that is in links.
    """
    holders: dict[int, Element] = {}
    for owner, text, links in found:
        points = (1 + text.count(",") + len(text) / 100) * max(0.0, 1 - links / len(text))
        holder = owner.up if owner.up and owner.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "tr", "dd", "dt", "figcaption") else owner
        for level in range(3):
            if holder is None or holder.tag == "#root" and level:
                break
            holder.score += points / (level + 1)
            holders[id(holder)] = holder
            holder = holder.up
    return max(holders.values(), key=lambda e: e.score * (1 - min(1.0, e.linked / max(e.text, 1))))


def main_text(page: str | None) -> str:
    """The article of a page: its best container, what stands around it in the same article, and siblings that score well.

    The best container is found by scored(). If an article element is around it, or else a main element, that element
    is the article and all of it stays. Otherwise the siblings of the best container and of those around it stay,
    however short, unless LINKED of their text is in links. What attached() finds goes in either case. A page without containers gives its whole text;
    skipped elements never count.
    """
    root = parsed(page or "")
    found = blocks(root)
    if not found:
        return ""
    totals(root, found)
    best = scored(found)
    chain = [best]
    while chain[-1].up is not None:
        chain.append(chain[-1].up)
    whole = next((e for kind in ("article", "main") for e in chain if e.tag == kind), None)
    inside = {id(whole or best)}
    on_way = {id(e) for e in chain}
    barred = attached(root, found, on_way)
    if not whole:
        inside = {id(chain[-1])}
        barred |= {id(p) for e in chain[1:] for p in e.parts if isinstance(p, Element) and id(p) not in on_way and p.text and p.linked >= LINKED * p.text}
    known: dict[int, bool] = {}

    def kept(element: Element) -> bool:
        way, up = [], element
        while up is not None and id(up) not in known and id(up) not in inside and id(up) not in barred:
            way.append(id(up))
            up = up.up
        answer = up is not None and (known[id(up)] if id(up) in known else id(up) in inside)
        known.update(dict.fromkeys(way, answer))
        return answer

    return " ".join(text for owner, text, _ in found if kept(owner))


def extracted(df: DataFrame, html: str = "html") -> DataFrame:
    """df without the html column, with text and n_chars (code points).

    Null and empty pages have an empty text; pages of any length are read whole, in time linear in their length, malformed
    tags and deep nesting included. Equally good containers: the first one. Repeated rows
    repeat, an empty table gives an empty result, and columns of df called text or n_chars are replaced.
    """
    keep = [c for c in df.columns if c not in (html, "text", "n_chars")]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").cast("string").alias(unused(df, "_html")))
    schema = T.StructType([*[df.schema[c] for c in keep], *T.StructType.fromDDL("text string, n_chars long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [main_text(x.as_py()) for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return src.mapInArrow(run, schema)
