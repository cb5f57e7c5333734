"""HTML extraction: pages are compared with the page of the nearest URL on their host, and shared lines go."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import values, written

#: Element names and marks. Text in CHROME or under a mark is never main text; RAW holds no text at all.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "title", "head")
CHROME = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
INLINE = ("a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
MARKS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header menu nav navbar navigation newsletter notice popup promo related replies share sharing sidebar social sponsored subscribe widget".split())
#: Parts of a class that say something about an element with or without the marked part, not that it is that part.
MODIFIERS = frozenset("has no not with without is open opened closed enabled disabled active layout page template".split())
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert")
#: Words that a page of its own has at least, and runs on either side among which a page looks for one that is no copy.
OWN, NEAR = 25, 3

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)", re.S)
#: What stands between two attributes, and one attribute: its whole name, and its value if it has one.
BETWEEN = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
READ = ("class", "id", "role", "hidden", "aria-hidden")


def attributes_at(html: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes that are read, of the tag whose name ends at `at`, and the place after the tag.

    Attributes are gone through one by one, so a name or a value that holds another's name is not taken for it; of two of
    the same name the first counts. A tag that is not closed goes on to the end of the page. No character is looked at
    more than a few times, whatever quotes are left open.
    """
    found: dict[str, str] = {}
    while True:
        at = BETWEEN.match(html, at).end()
        if at >= len(html):
            return found, at
        if html[at] == ">":
            return found, at + 1
        m = ATTRIBUTE.match(html, at)
        name = m[1].lower()
        if name in READ:
            found.setdefault(name, (m[2] or m[3] or m[4] or "").lower())
        at = m.end()


def _named(value: str) -> bool:
    """Whether a class or id names a menu, advert and the like: one of its words has a mark among its parts and no modifier."""
    parts = [re.split("[_-]+", token) for token in value.split()]
    return any(not MARKS.isdisjoint(p) and MODIFIERS.isdisjoint(p) for p in parts)


def _is_chrome(name: str, attributes: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element is chrome by its name, role or hiding, and whether by its class or id. A page, an article and
    main are never chrome by role, class or id."""
    if name in ("html", "body"):
        return False, False
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").strip() == "true"
    if name in ("article", "main"):
        return hidden, False
    firm = name in CHROME or hidden or attributes.get("role", "").strip() in ROLES
    return firm, _named(attributes.get("class", "")) or _named(attributes.get("id", ""))


#: Marks of a line: in no chrome, or in an element that is chrome whatever stands in it. Other marks are numbers from 1.
CLEAR, FIRM = 0, -1


def lines_of(html: str) -> list[tuple[str, str]]:
    """The text lines of a page in order, one for each block: (line, region), region being main (inside article or
    main), chrome (menus, adverts and the like) or other. Character references are decoded, white space is one space.

    A class or id does not make an element chrome that main stands in; nor one that article stands in, unless the page
    has other main text (teasers in a list of related pages are often articles). The work is that of the page's length:
    of the elements around that are chrome by class or id a line knows the innermost, and if main stands in that one, it
    stands in all.
    """
    lines: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # open elements: name, mark, main
    opened: Counter = Counter()  # names of the open elements
    never_closed: set[str] = set()  # names of raw elements that are not closed any more
    words: list[str] = []
    mark, main = CLEAR, False
    outer = [0]  # of each mark the one around it
    around: dict[str, set[int]] = {"article": set(), "main": set()}  # marks of the elements that these stand in

    def close_line() -> None:
        line = " ".join(unescape("".join(words)).split())
        words.clear()
        if line:
            lines.append((line, mark, main))

    def regions(free: set[int]) -> list[tuple[str, str]]:
        return [(line, "chrome" if c == FIRM or c != CLEAR and c not in free else "main" if m else "other") for line, c, m in lines]

    at, size = 0, len(html)
    while at < size:
        m = TAG.search(html, at)
        words.append(html[at : m.start()] if m else html[at:])
        if not m:
            break
        at = m.end()
        closing, name = m[1], (m[2] or "").lower()
        if not name:
            continue
        attributes, at = attributes_at(html, at)
        if name not in INLINE:
            close_line()
        if name in VOID:
            continue
        if closing:
            if opened[name]:
                while True:
                    gone = stack.pop()[0]
                    opened[gone] -= 1
                    if gone == name:
                        break
                now = stack[-1][1:] if stack else (CLEAR, False)
                if name in INLINE and now != (mark, main):
                    close_line()
                mark, main = now
        elif name in RAW:
            end = None if name in never_closed else re.compile(rf"</{name}\s*>", re.I).search(html, at)
            if not end:
                never_closed.add(name)
            at = end.end() if end else (at if name == "head" else size)
        else:
            firm, named = _is_chrome(name, attributes)
            if firm or named:
                if mark == CLEAR:
                    close_line()
                if firm or mark == FIRM:
                    mark = FIRM
                else:
                    outer.append(mark)
                    mark = len(outer) - 1
            elif name in around and not main and mark != FIRM:
                one = mark
                while one and one not in around[name]:
                    around[name].add(one)
                    one = outer[one]
            main = main or name in around
            stack.append((name, mark, main))
            opened[name] += 1
    close_line()
    found = regions(around["main"])
    return found if any(region == "main" for _, region in found) else regions(around["main"] | around["article"])


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of a with each prefix of b, the empty one first.

    A row of the table is the bits of one number, a zero where the length goes up; a line of a changes all of it at once.
    """
    places: dict[int, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    many = {line: sum(1 << j for j in at) for line, at in places.items() if len(at) > 64}
    full = (1 << len(b)) - 1
    row = full
    for line in a:
        mask = many.get(line)
        if mask is None:
            mask = 0
            for j in places.get(line, ()):
                mask |= 1 << j
        hit = row & mask
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _common(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence with b. Halves are solved in turn, so memory is that of a few rows."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, left, right = todo.pop()
        while lo < hi and left < right and a[lo] == b[left]:
            found.append(lo)
            lo, left = lo + 1, left + 1
        while lo < hi and left < right and a[hi - 1] == b[right - 1]:
            hi, right = hi - 1, right - 1
            found.append(hi)
        if lo >= hi or left >= right:
            continue
        if hi - lo == 1:
            found += [lo] if a[lo] in b[left:right] else []
            continue
        middle = (lo + hi) // 2
        upper, lower = _prefix_lengths(a[lo:middle], b[left:right]), _prefix_lengths(a[middle:hi][::-1], b[left:right][::-1])[::-1]
        cut = left + int(np.argmax(upper + lower))
        todo += [(lo, middle, left, cut), (middle, hi, cut, right)]
    return found


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Places in mine of a longest common subsequence with other."""
    known: dict[str, int] = {}
    for line in other:
        known.setdefault(line, len(known))
    places = [i for i, line in enumerate(mine) if line in known]
    wanted = {mine[i] for i in places}
    return {places[k] for k in _common([known[mine[i]] for i in places], [known[line] for line in other if line in wanted])}


def copies(mine: list[tuple[str, str]], other: list[tuple[str, str]]) -> bool:
    """Whether two pages have the same text outside of chrome, or all but a tenth and fewer than OWN words of each."""
    x, y = (Counter(line for line, region in lines if region != "chrome") for lines in (mine, other))

    def words(lines: Counter) -> int:
        return sum(n * len(line.split()) for line, n in lines.items())

    return all(own < OWN and own <= 0.1 * whole for own, whole in ((words(x - y), words(x)), (words(y - x), words(y))))


def main_text(lines: list[tuple[str, str]], neighbour: list[tuple[str, str]]) -> str:
    """The article: lines marked as main where the page marks any, else all that are not chrome and not shared.

    Lines inside the marked article are kept even if the neighbour has them: articles are copied between pages, and
    differencing alone would delete a copy whole.
    """
    gone = shared_lines([x for x, _ in lines], [x for x, _ in neighbour])
    marked = any(region == "main" for _, region in lines)
    return " ".join(x for i, (x, region) in enumerate(lines) if region == "main" or region == "other" and not marked and i not in gone)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)


def _alike(a: str, b: str) -> int:
    """Characters at the start that two paths have in common."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


ORDER = ("host", "path", "page_id", "key")


def _spot(row) -> tuple:
    """A page's place in the order of all: nulls first, strings by their bytes."""
    host, path, page_id, key = row
    return host.encode(), path.encode(), page_id is not None, page_id or 0, key.encode()


def bridges(spots: DataFrame, parts: int) -> tuple[list[tuple], dict[tuple, list[int]]]:
    """The first page of each of `parts` parts of the order, and of the pages outside a part those that it needs: the last
    of each of the NEAR runs of copies before it, and the first of each of the NEAR runs after it, on the same host.

    spots: the columns of ORDER. Of each part the pages at the ends of 2 x (NEAR + 1) runs reach the driver.
    """
    ranged = spots.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    held = written(ranged.select(F.struct(*ORDER).alias("spot"), F.spark_partition_id().alias("part")), "spots")
    content, line = F.struct("spot.host", "spot.key"), Window.partitionBy("part").orderBy("spot")
    runs = held.withColumn("run", F.sum((~content.eqNullSafe(F.lag(content).over(line))).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("part", "run").agg(F.min("spot").alias("first"), F.max("spot").alias("last"))
    ends = runs.withColumn("runs", F.max("run").over(Window.partitionBy("part"))).where((F.col("run") <= NEAR + 1) | (F.col("run") >= F.col("runs") - NEAR))
    of_part: dict[int, list] = {}
    for row in sorted(ends.collect(), key=lambda r: (r["part"], r["run"])):
        of_part.setdefault(row["part"], []).append(row)
    cut = list(of_part.values())
    needed: dict[tuple, list[int]] = {}
    for p, own in enumerate(cut):
        after, before = ((r["first"] for rows in cut[p + 1 :] for r in rows), own[-1]["last"]), ((r["last"] for rows in cut[:p][::-1] for r in rows[::-1]), own[0]["first"])
        for beyond, last in (after, before):
            found = 0
            for spot in beyond:
                if spot["host"] != last["host"] or found == NEAR:
                    break
                if spot["key"] != last["key"]:
                    needed.setdefault(_spot(spot), []).append(p)
                    found, last = found + 1, spot
    return [_spot(rows[0]["first"]) for rows in cut], needed


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html); null html is empty.

    Pages stand in the order of host, path and id; pages in a row with the same content (by MD5) are a run. A page is
    compared with the nearest run before its own and the nearest after it on its host, whichever shares more of its path,
    on a tie the one before. A run that is almost a copy of the page, and would delete the article, is passed over for
    the next, up to NEAR runs away; a page without any other is compared with nothing. The order is cut into as many
    parts as a shuffle has, whatever the size of a host, and a part is given the pages outside it that it needs, so the
    result does not depend on the cuts. Null urls stand together under the empty host. Repeated rows give repeated rows.
    Other columns are ignored. Memory: a batch of pages, the lines of 2 x NEAR + 1 runs, and the urls of their pages.
    """
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "page_id", F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("key"), "url", "html")
    firsts, needed = bridges(rows.select(*ORDER), parts)
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    @F.pandas_udf("array<int>")
    def parts_of(host: pd.Series, path: pd.Series, page_id: pd.Series, key: pd.Series) -> pd.Series:
        spots = (_spot((h, p, None if pd.isna(i) else int(i), k)) for h, p, i, k in zip(host, path, page_id, key))
        return pd.Series([[max(0, bisect_right(firsts, spot) - 1), *needed.get(spot, ())] for spot in spots])

    # the first of a row's parts is its own; ids go as strings, since a number and null do not go together in pandas
    dealt = rows.select("*", F.posexplode(parts_of("host", "path", F.col("page_id").cast("string"), "key")).alias("guest", "part"))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", *ORDER).select("part", "guest", *ORDER, "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # runs of one part and host: (part, host, key), paths of the first and the last page, lines, and path, id and url of pages
        runs: list[tuple[tuple, list[str], list[tuple[str, str]], list[tuple]]] = []
        next_one = 0  # the first of them that is not out yet

        def settled(n: int) -> list[tuple]:
            _, _, lines, held = runs[n]
            sides = (((r[1][1], r[2]) for r in runs[max(0, n - NEAR) : n][::-1]), ((r[1][0], r[2]) for r in runs[n + 1 : n + 1 + NEAR]))
            near = [x for side in sides if held and (x := next((x for x in side if not copies(lines, x[1])), None))]
            out, known = [], {}
            for path, page_id, url in held:
                other = max(near, key=lambda x: _alike(x[0], path), default=None)
                if id(other) not in known:
                    known[id(other)] = main_text(lines, other[1] if other else [])
                out.append((page_id, url, known[id(other)]))
            held.clear()
            return out

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            ids, urls, texts = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

        for batch in batches:
            out = []
            for part, guest, host, path, page_id, key, url, html in zip(*(values(c) for c in batch.columns)):
                if not runs or (part, host, key) != runs[-1][0]:
                    if runs and (part, host) != runs[-1][0][:2]:
                        out += [row for n in range(next_one, len(runs)) for row in settled(n)]
                        runs, next_one = [], 0
                    runs.append(((part, host, key), [path, path], lines_of(html or ""), []))
                    if len(runs) - next_one > NEAR + 1:
                        out += settled(next_one)
                        next_one += 1
                    if next_one > NEAR:
                        runs, next_one = runs[1:], next_one - 1
                runs[-1][1][1] = path
                if not guest:
                    runs[-1][3].append((path, page_id, url))
            if out:
                yield batch_of(out)
        if out := [row for n in range(next_one, len(runs)) for row in settled(n)]:
            yield batch_of(out)

    return dealt.mapInArrow(run, schema)
