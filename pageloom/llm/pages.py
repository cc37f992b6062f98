"""Main text of web pages: template deduction by nested equivalence classes of same-host tokens."""

from __future__ import annotations

import hashlib
import html as references
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import batch, cut

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
WHOLE = re.compile(r"""(?<![\w-])(class|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "option", "annotation", "annotation-xml"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo cite code data dfn em font i ins del kbd mark q s samp small span strong strike sub sup td th time tt u var wbr img input label ruby rt rp big center object param".split())
INLINE |= set("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
CLOSED_BY = {"p": None, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ASIDE = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"}
#: Name parts of elements that hold no article text.
WORDS_OUT = "ad|ads|adv|advert|adverts|advertisement|banner|sponsor|sponsored|promo|cookie|cookies|consent|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|sidebar|side|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|pagination|pager|footer|masthead|topbar|site-header|comment|comments|replies|disqus|respond|share|sharing|social|related|recommended|widget|toolbar|search|login|complementary|contentinfo"
NAMES_OUT = re.compile(rf"(?:^|[\s_-])(?:{WORDS_OUT})(?:$|[\s_-])", re.I)
FRAME = "area|article|articles|bar|block|body|box|button|buttons|card|cards|container|content|form|icons|inner|item|items|label|link|links|list|post|posts|section|slot|stories|story|teaser|text|unit|wrap|wrapper|[0-9]+"
#: In an article a whole class name, role or label must say so: words as above and words for their frame.
NAME_OUT = re.compile(rf"(?:(?:{FRAME})[_-]+)*(?:{WORDS_OUT})(?:[_-]+(?:{WORDS_OUT}|{FRAME}))*", re.I)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def named_out(attributes: str) -> bool:
    """Whether a class name, a role or the label of an element in an article says that it holds none of its text."""
    for kind, *values in WHOLE.findall(attributes):
        value = "".join(values)
        if any(NAME_OUT.fullmatch(x) for x in ([value.strip()] if kind.lower() == "aria-label" else value.split())):
            return True
    return False


def blocks(page: str) -> list[tuple[str, str, bool, bool]]:
    """(path, text, aside, main) of each block of text in page order.

    A path has the names, classes and ids of the open elements; aside: some of them is no article
    text by its name; main: one is an article or main element. Unclosed elements end where the
    next block element of their kind or an outer end tag says so.
    """
    out: list[tuple[str, str, bool, bool]] = []
    stack: list[tuple[str, str, bool, bool]] = []
    held: list[str] = []
    unclosed: set[str] = set()
    at = 0

    def flush() -> None:
        if held:
            text = " ".join(references.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((">".join(s[1] for s in stack), text, any(s[2] for s in stack), any(s[3] for s in stack)))

    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        held.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    flush_inside = any(s[0] not in INLINE for s in stack[i:])
                    if flush_inside:
                        flush()
                    del stack[i:]
                    break
            continue
        if name in RAW:
            if not m[3].endswith("/") and name not in unclosed:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                else:
                    unclosed.add(name)
            continue
        if name == "br" or name in ("td", "th", "wbr"):
            held.append("" if name == "wbr" else " ")
        elif name not in INLINE:
            flush()
            while stack and stack[-1][0] in INLINE and name in ("p", "div", "h1", "h2", "h3", "li", "table", "ul", "ol"):
                stack.pop()
            if stack and stack[-1][0] == "p":
                stack.pop()
            shut = CLOSED_BY.get(name)
            while shut and stack and stack[-1][0] in shut:
                stack.pop()
        if name in VOID or m[3].endswith("/"):
            continue
        named = " ".join(x for g in NAMED.findall(m[3]) for x in g if x)
        main = name in ("article", "main") or bool(re.search(r"\brole\s*=\s*.?main\b", m[3], re.I))
        inside = main or any(s[3] for s in stack)
        aside = name in ASIDE or (name == "header" and not inside) or bool(named and (named_out(m[3]) if inside else NAMES_OUT.search(named)))
        if name not in INLINE or aside:
            stack.append((name, f"{name}.{named}" if named else name, aside, main))
    flush()
    return out


def token(*parts: str) -> int:
    raw = "\x00".join(parts).encode("utf-8", "surrogatepass")
    return (zlib.crc32(raw) << 31) ^ zlib.adler32(raw[::-1])


def roles(paths: list[int], texts: list[int], places: list[int | None]) -> list[tuple[int, int, int, int]]:
    """(slot, text, number, block) of each block that has a place: three slots tell elements of one path at one place apart.

    They are its place among its like from the start and from the end, and the path as such, with the number of
    its like, the first of them as its block, and their text or 0 if it differs.
    """
    like: dict[tuple[int, int], list[int]] = {}
    for j, place in enumerate(places):
        if place is not None:
            like.setdefault((place, paths[j]), []).append(j)
    out = []
    for key, at in like.items():
        n, first = len(at), texts[at[0]]
        for i, j in enumerate(at):
            out += [(hash((key, 1, i)), texts[j], 1, j), (hash((key, 2, n - 1 - i)), texts[j], 1, j)]
        out.append((hash((key, 3)), first if all(texts[j] == first for j in at) else 0, n, at[0]))
    return out


class Tree:
    """A host's template: by round, each slot's class, the class's support, the token's number in it, and its text or 0."""

    def __init__(self, known: list[dict] | None):
        self.rounds: dict[int, dict[int, tuple[int, int, int, int]]] = {}
        for k in known or ():
            self.rounds.setdefault(k["round"], {})[k["slot"]] = (k["cls"], k["support"], k["at"], k["t"])


def parsed(paths: list[int], texts: list[int], tree: Tree, upto: int) -> tuple[list[int | None], dict[tuple[int, int], list[tuple[int, int]]]]:
    """Each block's place in the template of the rounds before `upto`, None if it is its text, and the classes' tokens.

    A place is a gap between two tokens of the innermost class around a block; before the first round a page
    is one place. Classes are (support, class) with their (number, block) in order.
    """
    places: list[int | None] = [0] * len(paths)
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    gone: set[int] = set()
    for r in range(1, upto):
        slots = tree.rounds.get(r)
        if not slots:
            continue
        for slot, text, _, j in roles(paths, texts, places):
            hit = slots.get(slot)
            if hit and (not hit[3] or hit[3] == text):
                spans.setdefault((hit[1], hit[0]), []).append((hit[2], j))
                if hit[3]:
                    gone.add(j)
                    if hash(((places[j], paths[j]), 3)) == slot:
                        gone.update(i for i, p in enumerate(paths) if p == paths[j] and places[i] == places[j])
        places = [0] * len(paths)
        for found in spans.values():
            found.sort(key=lambda x: (x[1], x[0]))
        for n, key in enumerate(sorted(spans, reverse=True)[:1] + sorted(spans, key=lambda k: (spans[k][0][1] - spans[k][-1][1], k))):
            found, cls = spans[key], key[1]
            if n == 0:  # the class of most pages is the root, which holds what is before and after it
                places = [hash((cls, 0))] * found[0][1] + [hash((cls, 1, found[-1][0]))] * (len(paths) - found[0][1])
            for (number, j), (_, end) in zip(found, found[1:]):
                places[j:end] = [hash((cls, 1, number))] * (end - j)
        for j in gone:
            places[j] = None
    return places, spans


def in_order(found: list[tuple[int, int]]) -> list[int]:
    """Places, in a list of (number, block) by number, of a longest part whose blocks do not fall."""
    tops: list[int] = []
    last: list[int] = []
    before = [-1] * len(found)
    for i, (_, j) in enumerate(found):
        k = bisect_right(tops, j)
        before[i] = last[k - 1] if k else -1
        tops[k : k + 1], last[k : k + 1] = [j], [i]
    out = []
    i = last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def content(found: list[tuple[str, str, bool, bool]]) -> int:
    """Hash of a page's article text, by which repeated and mirrored pages are one."""
    got = [x for x in found if not x[2]]
    raw = "\x00".join(x[1] for x in [x for x in got if x[3]] or got).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


SEEN = "host string, page bigint, paths array<bigint>, texts array<bigint>"
KNOWN = "struct<round:int,cls:bigint,support:bigint,slot:bigint,t:bigint,at:bigint>"


def _with(rows: DataFrame, template: DataFrame | None, broadcast_rows: int) -> DataFrame:
    """rows with `known`, their host's template, or null; broadcast within broadcast_rows counted rows."""
    if template is None:
        return rows.withColumn("known", F.lit(None).cast(f"array<{KNOWN}>"))
    per = template.groupBy("host").agg(F.collect_list(F.struct("round", "cls", "support", "slot", "t", "at")).alias("known"))
    return rows.join(F.broadcast(per) if template.count() <= broadcast_rows else per, "host", "left")


def _trees(part: pa.RecordBatch):
    """Each row's template; one of a host is made once."""
    made: dict[str, Tree] = {}
    known = part.column(part.schema.names.index("known"))
    for i, host in enumerate(part.column(part.schema.names.index("host")).to_pylist()):
        if host not in made:
            made[host] = Tree(known[i].as_py())
        yield made[host]


def candidates(seen: DataFrame, template: DataFrame | None, r: int, share: float, least: int, broadcast_rows: int) -> DataFrame:
    """Tokens (host, round, cls, support, slot, t, at) of the frequent classes of a round, not yet held against each other.

    Tokens are slots and the texts at them. Those that occur as often on the same pages are a class, by hashes of
    those pages and numbers, and a text's class holds the slot of its own element, which holds it: wherever the slot is, so
    is the text; as a text's pages are among its slot's, equal numbers are equal vectors. A slot without one text
    counts, as an element between texts, in classes of all pages or with texts, if it is a whole path. at, the
    sum of a token's blocks' numbers over its pages, puts a class's tokens in order.
    """

    def vectors(batches):
        for b in batches:
            rows: list[tuple] = []
            host, page, paths, texts = (b.column(b.schema.names.index(c)).to_pylist() for c in ("host", "page", "paths", "texts"))
            for h, g, p, t, tree in zip(host, page, paths, texts, _trees(b)):
                rows.append((h, g, 0, 0, 0, 0))
                places, _ = parsed(p, t, tree, r)
                whole = {hash(((place, path), 3)) for place, path in zip(places, p) if place is not None}
                rows += [(h, g, slot, text, -n if slot in whole else n, j) for slot, text, n, j in roles(p, t, places)]
            c = list(zip(*rows)) if rows else [()] * 6
            yield batch(dict(zip(("host", "page", "slot", "t", "n", "at"), ((list(x), y) for x, y in zip(c, [pa.string(), *[pa.int64()] * 5])))))

    each = _with(seen, template, broadcast_rows).mapInArrow(vectors, "host string, page bigint, slot bigint, t bigint, n bigint, at bigint")
    each = each.groupBy("host", "page", "slot", "t").agg(F.min("n").alias("n"), F.min("at").alias("at"))
    each = each.groupBy("host", "slot", "t").agg(F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", F.abs("n"))).alias("vec"), F.sum("at").alias("at"), F.min("n").alias("n"))
    each = each.groupBy("host", "slot").agg(F.max(F.struct("pages", "t")).alias("m"), F.sum("pages").alias("support"), F.bit_xor("vec").alias("cls"), F.sum("at").alias("at"), F.min("n").alias("n"))
    each = cut(each.where(f"slot = 0 or support >= {least}").select("host", "slot", "cls", "support", "at", F.when(F.expr("m.pages = support"), F.col("m.t")).otherwise(0).alias("t"), (F.col("n") < 0).alias("whole")))
    of = each.where("slot = 0").select("host", F.col("support").alias("of"))
    each = each.where("slot <> 0 and (t <> 0 or whole)").join(of, "host").where(F.col("support") >= share * F.col("of"))
    told = each.groupBy("host", "cls").agg(F.max(F.col("t") != 0).alias("told"))
    each = each.join(told, ["host", "cls"]).where("told or support = of")
    return cut(each.select("host", F.lit(r).alias("round"), "cls", "support", "slot", "t", "at"))


def valid(seen: DataFrame, template: DataFrame | None, found: DataFrame, r: int, broadcast_rows: int) -> DataFrame:
    """The found tokens whose classes are ordered and nested: the template's tree grows by them.

    On each page a class's tokens must stand in one order: those outside a longest ordered part of it on some page
    are no tokens of the class. New tokens on the pages of a known class join it where they fit its order. Two classes nest if on every page on which both are all of the one with less
    support is in the same gap of the other, or around it in the same gap of its own; else the one with less support goes.
    """
    both = found if template is None else template.unionByName(found)

    def checks(batches):
        for b in batches:
            odd: dict[tuple, tuple[int, int]] = {}
            host, paths, texts = (b.column(b.schema.names.index(c)).to_pylist() for c in ("host", "paths", "texts"))
            for h, p, t, tree in zip(host, paths, texts, _trees(b)):
                new = tree.rounds.get(r)
                if not new:
                    continue
                places, spans = parsed(p, t, tree, r)
                spans = {k: (0, v) for k, v in spans.items()}
                mine: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
                for slot, text, _, j in roles(p, t, places):
                    hit = new.get(slot)
                    if hit and (not hit[3] or hit[3] == text):
                        mine.setdefault((hit[1], hit[0]), []).append((hit[2], j, slot))
                for k, tokens in mine.items():
                    had = spans[k][1] if k in spans else []
                    fit = sorted(x for x in tokens if all((x[0] - number) * (x[1] - j) >= 0 for number, j in had))
                    kept = [fit[i] for i in in_order([x[:2] for x in fit])]
                    for x in set(tokens) - set(kept):
                        odd[h, x[2], None] = (0, 0)
                    if kept:
                        spans[k] = (1, sorted([*had, *(x[:2] for x in kept)], key=lambda x: (x[1], x[0])))
                order = sorted(spans, key=lambda k: (spans[k][0], -k[0], k[1]))
                for n, k in enumerate(order):
                    if not spans[k][0]:
                        continue
                    inner = spans[k][1]
                    at = [j for _, j in inner]
                    for o in order[:n]:
                        outer = spans[o][1]
                        js = [j for _, j in outer]
                        x, y = bisect_right(js, at[0]), bisect_right(js, at[-1])
                        u, v = bisect_left(at, js[0]), bisect_left(at, js[-1])
                        if x == y:
                            gap = outer[x - 1][0] if x else 0
                            gap = (gap, gap)
                        elif u == v:
                            gap = -1 - (inner[u - 1][0] if u else 0)
                            gap = (gap, gap)
                        else:
                            gap = (-(1 << 62), 1 << 62)
                        was = odd.get((h, k[1], o[1]), gap)
                        odd[h, k[1], o[1]] = (min(was[0], gap[0]), max(was[1], gap[1]))
            c = list(zip(*[(*k, *v) for k, v in odd.items()])) if odd else [()] * 5
            yield batch(dict(zip(("host", "of", "outer", "low", "high"), ((list(x), y) for x, y in zip(c, [pa.string(), *[pa.int64()] * 4])))))

    said = _with(seen, both, broadcast_rows).mapInArrow(checks, "host string, of bigint, outer bigint, low bigint, high bigint")
    said = cut(said.groupBy("host", "of", "outer").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("outer is null or low <> high"))
    moved = said.where("outer is null").select("host", F.col("of").alias("slot")).distinct()
    crossed = said.where("outer is not null").select("host", F.col("of").alias("cls")).distinct()
    return cut(found.join(moved, ["host", "slot"], "left_anti").join(crossed, ["host", "cls"], "left_anti").select(*found.columns))


def deduce(pages: DataFrame, share: float = 0.3, least: int = 3, rounds: int = 2, broadcast_rows: int = 1_000_000) -> DataFrame:
    """A host's template as the tokens of nested equivalence classes: host, round, cls, support, slot, t (0: no text) and at.

    Classes must be frequent, on `share` of the host's pages and `least` of them; pages with the same article
    text count once. The first round tells elements apart by path and place; those that are ordered and nest are
    the tree, and each further round tells the elements left apart by their gap in it, too, and adds
    what it finds. A sentence that many articles quote has no slot of its own and stays.
    """

    def tokens(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part, rows = b.slice(at, 200), []
                for url, html in zip(*(part.column(i).to_pylist() for i in range(2))):
                    found = blocks(html or "")
                    rows.append((host_of(url), content(found), [token(x[0]) for x in found], [token(x[1]) or 1 for x in found]))
                c = list(zip(*rows)) if rows else [()] * 4
                yield batch(dict(zip(("host", "page", "paths", "texts"), ((list(x), y) for x, y in zip(c, [pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 2])))))

    seen = cut(pages.select("url", "html").mapInArrow(tokens, SEEN))  # read twice a round: the pages are parsed for it once
    template = None
    for r in range(1, rounds + 1):
        found = valid(seen, template, candidates(seen, template, r, share, least, broadcast_rows), r, broadcast_rows)
        if template is not None and found.isEmpty():
            break
        template = found if template is None else cut(template.unionByName(found))
    return template.join(template.where("t <> 0").select("host").distinct(), "host", "left_semi")  # a tree without texts drops nothing


def main_text(pages: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """page_id, url, text and n_chars of each page: what its host's template leaves of the article.

    Blocks of the template and of menus, footers, forms, adverts, notices and reader comments go. Of
    the others those in article or main elements are taken if they hold half of the characters or more,
    else all, unless no element outside has more than they: a card that is marked as an article does not push out
    the body beside it, nor do a site's name and an imprint push out a short article. A null
    page is empty; null and odd urls are one host, without a name; unclosed tags end with the page.
    Templates are broadcast only within broadcast_rows counted rows, else joined by host. Repeated
    rows each get a row, an empty table none; columns other than page_id, url and html don't matter.
    """
    template = cut(deduce(pages, broadcast_rows=broadcast_rows))  # counted and joined
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    rows = _with(pages.select("page_id", "url", "html", host.alias("host")), template, broadcast_rows)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                out = []
                for html, tree in zip(part.column("html").to_pylist(), _trees(part)):
                    found = blocks(html or "")
                    places = [0] * len(found)
                    if tree.rounds:
                        places, _ = parsed([token(x[0]) for x in found], [token(x[1]) or 1 for x in found], tree, max(tree.rounds) + 1)
                    left = [x for x, place in zip(found, places) if place is not None and not x[2]]
                    inside, outside = [x for x in left if x[3]], Counter()
                    for path, text, _, main in left:
                        if not main:
                            outside[path.rpartition(">")[0] or path] += len(text)
                    if sum(len(x[1]) for x in inside) >= max(outside.values(), default=0):
                        left = inside or left
                    kept = [x[1] for x in left]
                    out.append("\n\n".join(kept))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array(np.array([len(t) for t in out], np.int64))], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return rows.select("page_id", "url", "html", "host", "known").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars bigint")
