"""Main text of web pages through wrappers: union-free regular expressions inferred from the pages of one host.

A page is a tree of block elements (inline ones are part of their text) and text tokens. A wrapper says what may stand in
an element: a sequence of elements, text slots, optional items and repeated groups. It starts as one page and is aligned
with the host's pages one after the other. Where texts differ a constant becomes a slot; where tags differ, runs of an
equal group of items become one repeated group, and what only one side still has becomes optional. A sequence that stays
long after that becomes a repeated group of optional items, so a wrapper is no larger than its host's kinds of elements.

A page's text is what the wrapper has slots for: the page is aligned with its host's wrapper, and texts at constants that
SUPPORT pages with different other texts share are the template's and leave, inside an article only those at its ends that
stand in elements of their own kind. Element names and class words only label slots as menus, footers, adverts and the like; if a page has an article, only its slots count.
A page of which the template would take over half is a copy of its neighbours and keeps all.

Only pages' structures and hashes of their texts are dealt out, in groups of about FAN of one host; a group gives one wrapper,
and wrappers go on in rounds, so a host's pages never meet in one task.
"""

import difflib
import hashlib
import html
import json
import operator
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catchwater.llm.session import cut

#: Pages whose different other texts make a constant text the template's.
SUPPORT = 4
#: Items of a group that may repeat, items in a sequence, nested elements; what is deeper belongs to the element there.
WIDEST, LONGEST, DEEPEST = 12, 48, 48
#: Wrappers aligned in one group.
FAN = 64
#: Characters of all wrappers up to which they go whole to every task.
BROADCAST = 16 << 20
#: Characters of a start tag up to which its meaning is remembered, for a template's tags come on every page.
SHORT = 200

# Element names and usual class words.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template head title textarea svg math iframe object canvas audio video select option".split())
AWAY = set("nav footer aside form menu dialog button fieldset".split())
WORDS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion footer menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related respond responses share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split())
#: Words that say nothing of an element beside one of WORDS.
PLAIN = set("area bar block bottom box btn button buttons container content element footer group header icons inner item items left links list main outer page panel post posts right row section side signup site slot small text title top unit wrap wrapper".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|=|[^>=]+)*+)(>|\Z)|([^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s/=>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")


def _attributes(text: str) -> dict[str, str]:
    """class, id and role by name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for a in _ATTR.finditer(text):
        if (name := a[1].lower()) in ("class", "id", "role"):
            out.setdefault(name, html.unescape(a[2] or a[3] or a[4] or ""))
    return out


def _away(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element is none of the article; a header counts unless it is the article's own.

    Inside the article a class or id must consist of listed and plain words only: press-notice is no notice.
    """
    if tag in SILENT or tag in AWAY or tag == "header" and not inside or attrs.get("role", "").lower() in ROLES:
        return True
    if tag in ("article", "main", "body", "html"):
        return "comment" in re.split(r"[^a-z]+", (attrs.get("class", "") + " " + attrs.get("id", "")).lower())
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        listed = [w in WORDS for w in words]
        if any(listed) and (not inside or all(x or w in PLAIN for w, x in zip(words, listed))):
            return True
    return False


def _tag(name: str, attributes: str) -> tuple[str, str, bool, bool, bool]:
    """Of a start tag: name, name in wrappers, whether it begins an article, whether it is away outside and inside one."""
    tag, attrs = name.lower(), _attributes(attributes) if attributes else {}
    inside = tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article")
    key = "<" + tag + "".join(f".{c}" for c in sorted(attrs.get("class", "").split())) + ">"
    return tag, key, inside, _away(tag, attrs, False), _away(tag, attrs, True)


_known_tag = lru_cache(1 << 13)(_tag)


def _last(stack: list, tag: str) -> int | None:
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] == tag:
            return k
    return None


def _code(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little") >> 12


# Items of a wrapper: [name, optional, content] for an element, a repeated group "+" of its content, or a repeated group
# "*" of any of its content; ["#", optional, code of a constant text or None, codes of other texts beside it, token numbers].


class Page:
    """content: the page's own wrapper; texts: of each text token its text, and whether it is inside and away."""

    def __init__(self, source: str):
        self.content: list = []
        self.texts: list[tuple[str, bool, bool]] = []
        # Name, content, whether it or an element around it is an article, or away.
        stack: list[tuple[str, list, bool, bool]] = []
        words: list[str] = []
        total = 0

        def flush():
            nonlocal total
            if not words:
                return
            text = " ".join(html.unescape("".join(words)).split())
            words.clear()
            if text:
                _, own, inside, away = stack[-1] if stack else ("", self.content, False, False)
                code = _code(text)
                own.append(["#", 0, code, [], [len(self.texts)]])
                self.texts.append((text, inside, away))
                if not away:
                    total += code

        def close(at: int):
            flush()
            del stack[at:]

        pos = 0
        while m := _TOKEN.match(source, pos):
            pos = m.end()
            ends, name, attributes, closed, text = m.groups()
            if text is not None:
                words.append(text)
                continue
            if name is None:
                continue
            if ends:
                tag = name.lower()
                at = _last(stack, tag)
                if at is not None:
                    close(at)
                elif tag not in INLINE:
                    flush()
                continue
            if not closed:
                break  # cut off inside a tag
            tag, key, inside, *aways = (_known_tag if len(name) + len(attributes) <= SHORT else _tag)(name, attributes)
            away = aways[bool(stack) and stack[-1][2]]
            if tag in ("script", "style", "textarea", "title", "noscript", "iframe"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, pos)
                pos = end.end() if end else len(source)
                continue
            if tag in INLINE and not (away and tag not in VOID):
                if tag in ("br", "wbr"):
                    words.append(" ")
                continue
            flush()
            if tag in VOID:
                continue
            if tag in CLOSES_P:
                at = _last(stack, "p")
                if at is not None and not any(x[0] in ("td", "th", "button", "object") for x in stack[at:]):
                    close(at)
            if tag in SIBLINGS:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                        break
                    if stack[k][0] in SIBLINGS[tag]:
                        close(k)
                        break
            own = stack[-1][1] if stack else self.content
            if len(stack) < DEEPEST:
                item = [key, 0, []]
                own.append(item)
                own = item[2]
            if tag not in ("svg", "path") or not attributes.rstrip().endswith("/"):
                around = stack[-1] if stack else ("", own, False, False)
                stack.append((tag, own, around[2] or inside and not away, around[3] or away))
        close(0)
        todo = [self.content]
        while todo:
            for item in todo.pop():
                if item[0] == "#":
                    item[3] = [(total - item[2]) % (1 << 52)]
                else:
                    todo.append(item[2])


def _key(item: list):
    return ("+", *map(_key, item[2])) if item[0] == "+" else item[0]


def _join(a: list, b: list) -> list:
    """One item for two of one key."""
    if a[0] == "#":
        return ["#", a[1] | b[1], a[2] if a[2] == b[2] else None, sorted({*a[3], *b[3]})[:SUPPORT], a[4] + b[4]]
    return [a[0], a[1] | b[1], align(a[2], b[2])]


def fold(content: list, groups: set) -> list:
    """Runs of an equal group of items as one repeated group; those in ``groups`` even where single. Adds new ones there."""
    again = True
    while again:
        again = False
        for w in range(1, WIDEST + 1):
            keys = [_key(x) for x in content]
            known = any(len(g) == w for g in groups)
            if not known and (len(keys) < 2 * w or not any(map(operator.eq, keys, keys[w:]))):
                continue
            out, i = [], 0
            while i < len(content):
                g, n = tuple(keys[i : i + w]), 1
                if len(g) == w and (w > 1 or g[0] != "#" and isinstance(g[0], str)):
                    while tuple(keys[i + n * w : i + (n + 1) * w]) == g:
                        n += 1
                    if n > 1 or g in groups:
                        groups.add(g)
                        parts = content[i : i + w]
                        for k in range(1, n):
                            parts = [_join(x, y) for x, y in zip(parts, content[i + k * w : i + (k + 1) * w])]
                        item = ["+", 0, parts]
                        if out and _key(out[-1]) == ("+", *g):
                            item = _join(out.pop(), item)
                        out.append(item)
                        i, again = i + n * w, True
                        continue
                out.append(content[i])
                i += 1
            content = out
    return content


def _mixed(items: list) -> list:
    """A repeated group of the items' kinds, each optional."""
    kinds: dict = {}
    todo = list(reversed(items))
    while todo:
        item = todo.pop()
        if item[0] in ("+", "*"):
            todo += reversed(item[2])
        else:
            item = [item[0], 1, *item[2:]]
            kinds[item[0]] = _join(kinds[item[0]], item) if item[0] in kinds else item
    return [["*", 0, list(kinds.values())]]


def align(a: list, b: list) -> list:
    """The content that matches what either content matches."""
    same = lambda: len(a) == len(b) and all(_key(x) == _key(y) for x, y in zip(a, b))
    if not same():
        if any(x[0] == "*" for x in a + b):
            return _mixed(a + b)
        groups = {_key(x)[1:] for x in a + b if x[0] == "+"}
        size = -1
        while size != len(groups):
            size = len(groups)
            a, b = fold(a, groups), fold(b, groups)
    if same():
        return [_join(x, y) for x, y in zip(a, b)]
    if len(a) > 4 * LONGEST or len(b) > 4 * LONGEST:
        return _mixed(a + b)
    out = []
    for kind, i, j, k, n in difflib.SequenceMatcher(None, [_key(x) for x in a], [_key(x) for x in b], autojunk=False).get_opcodes():
        if kind == "equal":
            out += [_join(x, y) for x, y in zip(a[i:j], b[k:n])]
        else:
            out += [[x[0], 1, *x[2:]] for x in a[i:j] + b[k:n]]
    return _mixed(out) if len(out) > LONGEST else out


def expression(content: list) -> str:
    """The wrapper as a regular expression over tags, with # for text slots and = for constant texts."""
    out = ""
    for item in content:
        if item[0] == "#":
            own = "#" if item[2] is None else "="
        else:
            own = expression(item[2])
            own = f"({own})+" if item[0] in ("+", "*") else f"{item[0]}{own}</{item[0][1:]}"
        out += f"({own})?" if item[1] else own
    return out


def infer(pages: list[Page]) -> list:
    """The wrapper of pages of one host."""
    out = pages[0].content
    for page in pages[1:]:
        out = align(out, page.content)
    return out


def _bare(content: list) -> list:
    """Without token numbers."""
    return [[*x[:4], []] if x[0] == "#" else [x[0], x[1], _bare(x[2])] for x in content]


def main_text(page: Page, wrapper: list) -> str:
    """The texts at slots of the wrapper that are not away; of those in the article if there is one.

    Inside an article a constant leaves only where its place says so too: before the first slot or after the last one, in a
    kind of element that has no slots.
    """
    fixed, slotted, todo = {}, set(), [("", align(wrapper, page.content))]
    while todo:
        kind, content = todo.pop()
        for item in content:
            if item[0] != "#":
                todo.append((kind if item[0] in ("+", "*") else item[0], item[2]))
            elif item[2] is None:
                slotted.add(kind)
            elif len(item[3]) >= SUPPORT:
                fixed.update(dict.fromkeys(item[4], kind))
    article = any(inside for _, inside, _ in page.texts)
    own = [(k, text) for k, (text, inside, away) in enumerate(page.texts) if (inside or not article) and not away]
    if article:
        free = [k for k, _ in own if k not in fixed]
        fixed = {k: kind for k, kind in fixed.items() if kind not in slotted and free and not free[0] < k < free[-1]}
    taken = sum(len(text) for k, text in own if k in fixed)
    copies = 2 * taken > sum(len(text) for _, text in own)
    return "\n".join(text for k, text in own if copies or k not in fixed)


_WRAPPERS = "host string, wrapper string"


def _batch(hosts: list, contents: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([json.dumps(_bare(x)) for x in contents], pa.string())], ["host", "wrapper"])


def _contents(batches):
    """Each page as a wrapper of its own."""
    for batch in batches:
        yield _batch(batch.column("host").to_pylist(), [Page(source or "").content for source in batch.column("html").to_pylist()])


def _aligned(table: pa.Table) -> pa.Table:
    """One wrapper for a group of wrappers of one host."""
    out = None
    for own in map(json.loads, sorted(table.column("wrapper").to_pylist())):
        out = own if out is None else align(out, own)
    return pa.Table.from_batches([_batch([table.column("host")[0].as_py()], [out])])


def wrappers(rows: DataFrame) -> DataFrame:
    """host, html -> host, wrapper (JSON of items): one row a host.

    Groups are dealt by the contents' hashes and aligned in the contents' order, so neither the order of the pages nor the
    files they come in change a wrapper.
    """
    found = cut(rows.select("host", "html").mapInArrow(_contents, _WRAPPERS).distinct())
    while True:
        sizes = found.groupBy("host").agg(F.ceil(F.count("*") / FAN).alias("parts"), F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return found
        part = F.pmod(F.xxhash64("wrapper"), "parts")
        found = cut(found.join(sizes, "host").select("host", "wrapper", F.xxhash64("host", part).alias("group")).groupBy("host", "group").applyInArrow(_aligned, _WRAPPERS))


def _extracted(batches):
    text, wrapper = None, []
    for batch in batches:
        found = []
        for source, own in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist()):
            if own != text:
                text, wrapper = own, json.loads(own)
            found.append(main_text(Page(source or ""), wrapper))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), batch.column("host")], ["page_id", "url", "text", "host"])


def _hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host)


def extract(pages: DataFrame) -> DataFrame:
    """pages -> page_id, url, text (the main text's blocks, a line each), host; one row for each row of pages.

    A null or empty html gives an empty text; pages without a url are of one host ""; ids may be null or repeat, and
    equal pages count once as support, so copies keep their text. What is cut off inside a tag ends there. An empty table
    gives an empty table; other columns are left behind.
    """
    rows = _hosts(pages)
    found = wrappers(rows)
    if (found.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0) <= BROADCAST:
        found = F.broadcast(found)
    # Beyond that a plain join, in which pages of a hot host may be split, as nothing groups them.
    return rows.join(found, "host").select("page_id", "url", "html", "host", "wrapper").mapInArrow(_extracted, "page_id long, url string, text string, host string")
