"""Spellings of names typed by people, linked to the person, duo or group they mean.

Method: merge-and-rematch resolution. A name is parsed into its kind (person, duo, group, bare), its distinguishing core
(the family name or the name of a group) and its attributes (given names, initials or the kind of group). What a word
means is learned from the corpus, not listed: given names and kinds of groups are words that stand beside many rarer ones,
the former mostly first, the latter mostly last; a nickname, a short form or a typing error stands beside the same cores
as the word it stands for.

Equal parses start as one profile. Profiles whose attributes and cores agree merge; a profile with initials, shortened or
no attributes merges with the only artist that it fits. A merged profile unites the cores, initials and names of its
members, also to combinations that none of them has ("R. & Wilmund", "Roswithe & W."): these enter blocking again as new
forms of the profile, against all forms, until no round brings a new form or a new link. A shared core alone links nothing
where it fits two artists.

Blocking is by deletion keys of the cores, joined with kind and attributes where these are known.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewave.llm.graph import class_pairs, components
from cratewave.storage import discard, materialize

PLAIN = str.maketrans({"ø": "o", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ß": "ss", "æ": "ae", "đ": "d", "œ": "oe"})
#: A word is common from so many different neighbours on, spellings of one word counted once, whatever the table's size.
COMMON = 5
#: Common words and meanings that are sent to the driver and to all tasks at most: a vocabulary, not data. More is an error.
MAX_WORDS = 200_000
#: Full forms of one block up to which it is joined in one piece.
HOT_BLOCK = 2_000


def fold(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.lower().translate(PLAIN))
    return "".join(c for c in text if not unicodedata.combining(c)).translate(PLAIN)


def near(a: str, b: str, most: int) -> bool:
    """Whether two words are within `most` insertions, deletions, changes and swaps of neighbours."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return False
        before, last = last, row
    return last[-1] <= most


def slack(word: str) -> int:
    """Typing errors that a word of common vocabulary may have."""
    return 0 if len(word) < 4 else 1 if len(word) < 7 else 2


def shorter(word: str) -> set[str]:
    """The word and all forms with one character less."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def abbreviates(short: str, word: str) -> bool:
    """Whether a shorter word begins as the other and has its letters in the same order."""
    rest = iter(word)
    return len(short) < len(word) and short[:1] == word[:1] and all(c in rest for c in short)


def words_of(name: str) -> list[str]:
    """Folded words of a name without a quoted nickname; "&" between the members of a duo, "," kept, a dot kept at
    shortened words; dotted letters in a row are one word."""
    out = []
    name = re.sub(r"(?<=\s)['‘\"“][^'’\"”]+['’\"”](?=\s)", " ", f" {name} ")
    for i, c in enumerate(name):
        if c.isupper() and name[i - 1].islower() and name[i : i + 3].isalpha() and sum(x.isupper() for x in name) < len(name) / 2:
            out.append(" ")
        out.append(c)
    s = re.sub(r"(?<=\w)['’](?=\w)", "", fold("".join(out)))
    s = re.sub(r"\b([a-z])\.\s*([a-z])\.", r"\1\2.", s)
    s = re.sub(r"\s(?:and|und)\s|[&+/]", " & ", s)
    return re.findall(r"[a-z0-9']+\.?|&|,", s)


def quoted(name: str) -> tuple[str, str] | None:
    """(given name, nickname) of a name such as: Anthony 'Tony' Gostu."""
    m = re.search(r"([^\s]+)\s+['‘\"“]([^'’\"”\s]+)['’\"”]\s", f"{name} ")
    return (fold(m[1]), fold(m[2])) if m else None


def index_of(words: Iterable[str], most: Callable[[str], int]) -> dict[str, list[str]]:
    """Words by all forms that lack up to `most` of their characters."""
    out: dict[str, list[str]] = {}
    for w in words:
        for key in lacking(w, most(w)):
            out.setdefault(key, []).append(w)
    return out


def lacking(word: str, n: int) -> set[str]:
    """The word and all forms with up to n characters less."""
    forms = {word}
    for _ in range(n):
        forms |= {f for w in forms for f in shorter(w)}
    return forms


class Lexicon:
    """Common words of the corpus, what they are, and what other words mean."""

    def __init__(self, words: list[tuple[str, int, float, float]], bigrams: list[str], shared: list[tuple[str, str, int, int]], told: list[tuple[str, str]]) -> None:
        """`words`: (word, names it stands in, share of them in which it is first, share of names of three words or more
        among those of no duo). `bigrams`: words that belong together. `shared`: (word, common word, cores that both stand
        beside, cores of the word). `told`: (given name, nickname)."""
        count = {w: n for w, n, _, _ in words}
        first = {w: f for w, _, f, _ in words}
        self.joined = {tuple(b.split(" ")) for b in bigrams}
        self.stop = {w for w, _, f, wide in words if f > 0.9 and wide > 0.8}
        is_group = lambda w: first[w] < 0.4
        halves = {h for pair in self.joined for h in pair}
        common = [w for w, *_ in sorted(words, key=lambda z: (-z[1], z[0])) if w not in self.stop and w not in halves and len(w) > 2]
        means: dict[str, dict[str, int]] = {}
        for w, g, both, own in shared:
            if g not in count or g in self.stop or w == g or self._is_stop(w) and not abbreviates(w, g) or (w in first and is_group(w) != is_group(g)):
                continue
            if both >= 0.2 * own and (both >= 3 or 2 * both >= own and len(w) <= len(g) + 1 or near(w, g, 1 + (len(w) > 6)) or abbreviates(w, g)):
                means.setdefault(w, {})[g] = both
        for x, y in self.joined:
            means.setdefault(x[0] + y[0], {x + y: 1})
        for given, nick in told:
            near_ = given if given in count else next((g for g in common if not is_group(g) and near(given, g, slack(g))), given)
            means.setdefault(nick, {}).setdefault(near_, 1)
        #: Common words that stand for themselves; of two spellings of one word the more frequent one.
        self.given: set[str] = set()
        self.groups: set[str] = set()
        for w in common:
            more = means.get(w, {})
            if not any(count.get(g, 0) > count[w] for g in more):
                vocabulary = self.groups if is_group(w) else self.given
                like = [g for g in (*self.groups, *self.given) if count[g] >= 4 * count[w] and near(w, g, min(slack(w), slack(g)))]
                like = like or [g for g in vocabulary if count[g] >= 4 * count[w] and (g.startswith(w) or is_group(w) and abbreviates(w, g))]
                if len(like) == 1:
                    means.setdefault(w, {})[like[0]] = 1
                else:
                    vocabulary.add(w)
        self.means: dict[str, list[str]] = {}
        for w, found in means.items():
            if w in self.given or w in self.groups:
                continue
            ends = {e for g in found for e in self._ends(g, means)}
            best = max(found.values())
            strong = {e for g, n in found.items() if n >= 0.4 * best for e in self._ends(g, means)}
            self.means[w] = sorted(strong or ends)
        # a given name that is only told of with its nicknames is one, too
        self.given |= {g for found in self.means.values() for g in found if g not in self.groups}
        self.near_given, self.near_group = (index_of(v, slack) for v in (self.given, self.groups))
        self.near_other = index_of((w for w in self.means if len(w) >= 4), lambda w: 1)
        self.starts: dict[str, list[str]] = {}
        for g in sorted(self.given):
            for k in range(3, 6):
                self.starts.setdefault(g[:k], []).append(g)
        self.cache: dict[str, str | None] = {}

    def _ends(self, w: str, means: dict[str, dict[str, int]], depth: int = 4) -> set[str]:
        """What a word means where that has a meaning itself."""
        if w in self.given or w in self.groups or w not in means or not depth:
            return {w}
        top = max(means[w].items(), key=lambda z: (z[1], z[0]))[0]
        return self._ends(top, means, depth - 1)

    def attribute(self, word: str) -> str | None:
        """"=name" of a given name, "?a|b" of a nickname of several, "~x" of a shortened one, "#word" of a group, or None."""
        if word not in self.cache:
            self.cache[word] = self._attribute(word)
        return self.cache[word]

    def _meant(self, names: list[str]) -> str:
        if names[0] in self.groups:
            return "#" + names[0]
        return "=" + names[0] if len(names) == 1 else "?" + "|".join(names)

    def _attribute(self, word: str) -> str | None:
        dotted, w = word.endswith("."), word.rstrip(".")
        if len(w) == 1:
            return "~" + w if w.isalpha() else None
        if w in self.groups:
            return "#" + w
        if w in self.given:
            return "=" + w
        if w in self.means:
            return self._meant(self.means[w])
        kinds = {g for g in self.groups if g.startswith(w) or len(w) <= 5 and abbreviates(w, g)} if len(w) > 2 else set()
        typed = {n for key in shorter(w) for n in self.near_other.get(key, ()) if near(n, w, 1)} if len(w) >= 4 else set()
        meant = sorted({g for n in typed for g in self.means[n]})
        if dotted and len(w) <= 4:
            kinds |= {g for g in meant if g in self.groups}
            return "#" + kinds.pop() if len(kinds) == 1 and not any(g.startswith(w) for g in self.given) else "~" + w
        for index, mark in ((self.near_given, "="), (self.near_group, "#")):
            close = {g for key in lacking(w, slack(w)) for g in index.get(key, ())}
            close = [g for g in close if g[0] in w[:2] and near(g, w, slack(min(g, w, key=len)) or (len(g) == 3 and g[0] == w[0] and len(w) > 2))]
            if close:
                return mark + min(close, key=lambda g: (not near(g, w, 1), g))
        if dotted:
            return "~" + w
        starts = self.starts.get(w, ())
        if len(starts) == 1:
            return "=" + starts[0]
        if meant:
            return self._meant(meant)
        return "#" + kinds.pop() if len(kinds) == 1 else None

    def parse(self, name: str) -> tuple[str, str, str]:
        """(kind p, d, g or b, core, attributes joined by a blank). An empty core marks a name without letters."""
        words = words_of(name)
        tokens: list[str] = []
        for w in words:
            plain = w.rstrip(".")
            if len(words) > 1 and len(plain) > 1 and self._is_stop(plain) and not (w != plain or plain in self.means or plain in self.starts):
                continue
            pair = next((a + b for a, b in self.joined if tokens and len(plain) > 3 and near(plain, b, 2) and near(tokens[-1].rstrip("."), a, 1)), None)
            if pair:
                tokens[-1] = pair
            else:
                tokens.append(w)
        split: list[str] = []
        for w in tokens:
            split += self._unglue(w) if len(w) >= 9 and self.attribute(w) is None else [w]
        comma = split.index(",") if "," in split else None
        duo = "&" in split
        items = [w for w in split if w not in (",", "&")]
        marks = [self.attribute(w) for w in items]
        rest = [i for i, m in enumerate(marks) if m is None]
        if not items:
            return "b", "", ""
        if not rest:
            # every word is known: the core is the last one, or the one before the comma, that is no group word
            free = [i for i, m in enumerate(marks) if m and m[0] != "#" and len(items[i].rstrip(".")) > 1] or list(range(len(items)))
            rest = [free[0] if comma is not None and free[0] < comma else free[-1]]
        elif len(rest) > 1 and not duo:
            keep = rest[0] if comma is not None and rest[0] < comma else rest[-1]
            for i in rest:
                if i != keep:
                    marks[i] = "=" + items[i].rstrip(".")
            rest = [keep]
        elif len(rest) > 2:
            # a duo of uncommon given names: the core is before the comma, or on the side with more words, at its outer end
            ahead = sum(w not in (",", "&") for w in split[: split.index("&")])
            keep = rest[0] if comma is not None or len(items) - ahead == 1 else rest[-1] if ahead == 1 else None
            for i in rest if keep is not None else ():
                if i != keep:
                    marks[i] = "=" + items[i].rstrip(".")
            rest = rest if keep is None else [keep]
        cores = sorted({normal(items[i].rstrip(".")) for i in rest}, key=lambda c: (-len(c), c))
        if len(cores) > 1 and all(near(cores[0], c, 2) for c in cores[1:]):
            cores = cores[:1]
        attributes = sorted({m for i, m in enumerate(marks) if i not in rest and m})
        kind = "g" if any(m[0] == "#" for m in attributes) else "d" if duo or len(attributes) > 1 else "p" if attributes else "b"
        if kind == "g":
            attributes = [m for m in attributes if m[0] == "#"]
        return kind, " ".join(sorted(cores)), " ".join(attributes)

    def _is_stop(self, w: str) -> bool:
        """Whether a word is one that tells nothing, such as an article, or a typing error of one."""
        return w in self.stop or len(w) > 2 and any(len(s) > 2 and abs(len(s) - len(w)) < 2 and near(w, s, 1) for s in self.stop)

    def _unglue(self, word: str) -> list[str]:
        for g in self.groups:
            if len(g) > 4 and word.endswith(g) and len(word) - len(g) >= 4:
                return [word[: -len(g)], g]
        for g in self.groups:
            for n in (len(g), len(g) - 1, len(g) + 1):
                if len(g) >= 7 and len(word) - n >= 5 and near(word[-n:], g, 1):
                    return [word[:-n], g]
        return [word]


def normal(core: str) -> str:
    """A core as it sounds: one spelling of letters that are typed for each other, doubled letters once."""
    core = core.replace("'", "").replace("ck", "k").replace("ph", "f").replace("y", "i").replace("w", "v").replace("0", "o").replace("1", "l")
    return re.sub(r"(.)\1", r"\1", core)


def fits(partial: str, full: str) -> bool:
    """Whether attributes with shortened ones can mean full attributes."""
    a, b = partial.split(), full.split()
    if not a:
        return True
    if len(a) != len(b):
        return False
    if len(a) == 1:
        return _fits(a[0], b[0])
    return any(all(_fits(x, y) for x, y in zip(a, order)) for order in (b, b[::-1]))


def _fits(x: str, y: str) -> bool:
    if x == y:
        return True
    if y[0] == "~" and x[0] == "~":
        return len(x) < len(y) and y.startswith(x)
    if y[0] != "=" or x[0] == "#":
        return False
    if x[0] == "~":
        part, whole = normal(x[1:]), normal(y[1:])
        return whole.startswith(part) or len(part) > 2 and whole[0] == part[0] and any(near(whole[:k], part, 1) for k in (len(part) - 1, len(part), len(part) + 1))
    if x[0] == "?":
        return y[1:] in x[1:].split("|")
    return similar_given(x[1:], y[1:])


def similar_given(x: str, y: str) -> bool:
    """Two given names outside the common ones: typing errors, a shortening, or the end of the other."""
    if near(x, y, max(slack(min(x, y, key=len)), x[0] == y[0] and min(len(x), len(y)) > 2)):
        return True
    short, long = sorted((x, y), key=len)
    return len(short) >= 3 and (long.startswith(short) or len(short) >= 4 and long.endswith(short))


def core_slack(a: str, b: str) -> int:
    """Typing errors between cores of one artist."""
    n = min(len(a), len(b))
    return 0 if n < 5 else 1 if n < 9 else 2


def deletions(core: str) -> list[str]:
    """The core and all forms with one character less."""
    return sorted(shorter(core)) if len(core) >= 5 else [core]


def unlike(words: list[str], most: int) -> list[str]:
    """Some words, up to `most`, that are no typing errors of each other: the first ones that are none of those before."""
    kept: list[str] = []
    for w in words:
        if len(kept) == most:
            break
        if not any(near(w, k, max(1, slack(min(w, k, key=len)))) for k in kept):
            kept.append(w)
    return kept


def lexicon_of(names: DataFrame) -> Lexicon:
    """What the words of distinct (name) rows are and mean. A word is common if it has at least `COMMON` different
    neighbours, most of them rarer than itself. It means a common word of twice its names if it stands beside the same
    cores. Neither depends on the number of other rows. More than `MAX_WORDS` common words or meanings are an error."""
    spark = names.sparkSession

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[str, str, int, int, int]] = []
            for name in b.column("name").to_pylist():
                all_ = [w.rstrip(".") for w in words_of(name)]
                plain = [w for w in all_ if w not in ("&", ",")]
                single = "&" not in all_
                units = [(i, w, {w}) for i, w in enumerate(plain) if w.isalnum() and len(w) > 1]
                if len(plain) > 2 and len(all_) == len(plain):
                    units += [(i, f"{x} {y}", {x, y}) for i, (x, y) in enumerate(zip(plain, plain[1:])) if min(len(x), len(y)) > 2]
                for i, w, own in dict((u[1], u) for u in units).values():
                    rows.append((w, "", int(i == 0), int(single and len(plain) > 2), int(single)))
                    rows += [(w, v, 0, 0, 0) for v in {v for v in plain if v not in own and len(v) > 2 and v.isalpha()}]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k < 2 else pa.int64()) for k in range(5)], ["w", "v", "first", "wide", "single"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [q for q in map(quoted, b.column("name").to_pylist()) if q]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in found], pa.string()), pa.array([n for _, n in found], pa.string())], ["given", "nick"])

    def different(group: pa.Table) -> pa.Table:
        order = sorted(zip([-k for k in group["n"].to_pylist()], group["v"].to_pylist()))
        kept = set(unlike([v for _, v in order], COMMON))
        return group.filter(pa.array([v in kept for v in group["v"].to_pylist()])).select(["w", "v", "n"])

    pairs = names.mapInArrow(beside, "w string, v string, first bigint, wide bigint, single bigint").groupBy("w", "v").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("first", "wide", "single")])
    pairs = materialize(pairs, "neighbours")
    own = pairs.where("v = ''").select("w", F.col("n").alias("own"), "first", "wide", "single")
    its = own.where(~F.contains("w", F.lit(" "))).select(F.col("w").alias("v"), F.col("own").alias("its"))
    rarer = F.sum(F.when(F.col("its") < F.col("own"), F.col("n")).otherwise(0)) / F.sum("n")
    several = pairs.where("v <> ''").join(own.where(f"own >= {COMMON}").select("w", "own"), "w").join(its, "v")
    wanted = several.groupBy("w").agg(F.count("*").alias("different"), rarer.alias("rarer")).where(f"different >= {COMMON} and rarer >= 0.6").select("w")
    # the neighbours of a family name may be many spellings of one given name: counted in salted parts, then together
    salted = several.join(wanted, "w").select("w", "v", "n", F.pmod(F.xxhash64("v"), F.lit(16)).alias("s")).groupBy("w", "s").applyInArrow(different, "w string, v string, n bigint")
    common = salted.groupBy("w").applyInArrow(different, "w string, v string, n bigint").groupBy("w").count().where(f"count >= {COMMON}").select("w")
    found = common.join(own, "w").limit(MAX_WORDS + 1).collect()
    near_ = F.broadcast(spark.createDataFrame([(r.w,) for r in found[:MAX_WORDS] if " " not in r.w], "w string"))
    mutual = pairs.where("v <> ''").join(near_, "w").join(near_.select(F.col("w").alias("v")), "v").select("w", "v", "n").limit(10 * MAX_WORDS + 1).collect()
    mass = {r.w: r.n for r in pairs.where("v <> ''").join(near_, "w").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    found = _without_cores(found, [(r.w, r.v, r.n) for r in mutual], mass)
    words = [(r.w, r.own, r["first"] / r.own, r.wide / max(1, r.single)) for r in found if " " not in r.w]
    count = {w: n for w, n, *_ in words}
    bigrams = [r.w for r in found if " " in r.w and all(r.own >= 0.6 * count.get(x, 0) for x in r.w.split(" ")) and not set(r.w.split(" ")) & {w for w, _, f, wide in words if f > 0.9 and wide > 0.8}]
    known = spark.createDataFrame([(w, n) for w, n in sorted(count.items())] + [(b.replace(" ", ""), 1 << 40) for b in bigrams], "g string, total bigint")
    # words and common words beside the same core, which is itself no common word; words that belong together are one
    one = pairs.where("v <> ''").select(F.replace("w", F.lit(" "), F.lit("")).alias("w"), "v", F.contains("w", F.lit(" ")).alias("two"))
    one = one.where(~F.col("two") | F.col("w").isin([b.replace(" ", "") for b in bigrams])).join(known.select(F.col("g").alias("v")), "v", "left_anti").select("w", "v").distinct()
    if bigrams:
        halves = [h for b in bigrams for h in b.split(" ")]
        one = one.where(~F.col("w").isin(halves) & ~F.col("v").isin(halves))
    one = materialize(one, "cores")
    both = one.join(one.join(F.broadcast(known), one["w"] == known["g"]).select("v", "g", "total"), "v").where("w <> g").groupBy("w", "g").agg(F.count("*").alias("both"), F.first("total").alias("total")).where("both >= 2")
    both = both.join(one.groupBy("w").agg(F.count("*").alias("cores")), "w").join(own.select("w", "own"), "w").where("total >= 2 * own and both >= 0.2 * cores")
    # beside a core stand common words: what stands beside them half of the time is no word for one
    plain = [w for w, _, f, wide in words if not (f > 0.9 and wide > 0.8)]
    among = pairs.where("v <> ''").join(F.broadcast(spark.createDataFrame([(w,) for w in plain], "v string")).withColumn("c", F.lit(1)), "v", "left")
    among = among.groupBy("w").agg((F.sum(F.when(F.col("c") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("among")).where("among < 0.5").select("w")
    both = both.join(among, "w", "left_semi")
    shared = both.select("w", "g", "both", "cores").limit(MAX_WORDS + 1).collect()
    nicknames = names.mapInArrow(told, "given string, nick string").groupBy("given", "nick").count().limit(MAX_WORDS + 1).collect()
    if max(len(found), len(shared), len(nicknames), len(mutual) // 10) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} common words or meanings")
    discard(pairs, one)
    words += [(b.replace(" ", ""), r.own, 0.0 if r["first"] / r.own < 0.4 else 1.0, 0.0) for r in found for b in [r.w] if b in bigrams]
    return Lexicon(sorted(words), sorted(bigrams), sorted((r.w, r.g, r.both, r.cores) for r in shared), sorted((r.given, r.nick) for r in nicknames))


def _without_cores(found: list, mutual: list[tuple[str, str, int]], mass: dict[str, int]) -> list:
    """Common words (w, own, first, wide) less those that are cores: a family name that many share stands beside common
    words, most of the time, and those beside rare ones. The clearest cases go first, as they count for the others."""
    stop = {r.w for r in found if r["first"] > 0.9 * r.own and r.wide > 0.8 * max(1, r.single)}
    beside: dict[str, dict[str, int]] = {}
    for w, v, n in mutual:
        if v not in stop:
            beside.setdefault(w, {})[v] = n
    among = {w: sum(b.values()) for w, b in beside.items() if w not in stop}
    gone: set[str] = set()
    heap = [(-n / mass[w], w) for w, n in among.items()]
    heapq.heapify(heap)
    while heap:
        share, w = heapq.heappop(heap)
        if w in gone or -share != among[w] / mass[w]:
            continue  # out of date
        if -share < 0.5:
            break
        gone.add(w)
        for v in beside[w]:
            if v in among and v not in gone and w in beside.get(v, ()):
                among[v] -= beside[v][w]
                heapq.heappush(heap, (-among[v] / mass[v], v))
    return [r for r in found if r.w not in gone]


FORM = "form bigint, kind string, core string, attributes string"
FULL = "kind <> 'b' and not attributes rlike '[~?]'"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocking keys of forms: `strict` ones tell kind, core and attributes up to one typing error on either side, the
    others (null) only the core."""
    for b in batches:
        out: list[tuple[int, str, bool]] = []
        for i, (kind, core, attributes) in enumerate(zip(*(b.column(c).to_pylist() for c in ("kind", "core", "attributes")))):
            near_core = deletions(core)
            out += [(i, k, False) for k in near_core]
            out += [(i, f"{kind} {attributes}\x1f{k}", True) for k in near_core]
            if kind in "pd" and not re.search("[~?]", attributes):
                words = [w[1:] for w in attributes.split()]
                typed = {f for w in words for f in (*shorter(w), "^" + w[:3], "$" + w[-4:])}
                out += [(i, f"{kind}\x1e{core}\x1f{f}", True) for f in typed]
        at = pa.array([i for i, *_ in out], pa.int64())
        yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array([k for _, k, _ in out], pa.string()), pa.array([s for *_, s in out], pa.bool_())], [*b.schema.names, "block", "strict"])


def _check(agree: Callable[[str, str, str, str], bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(n).to_pylist() for n in ("core_a", "core_b", "attributes_a", "attributes_b")]
            yield b.select(["a", "b"]).filter(pa.array([agree(*x) for x in zip(*columns)], pa.bool_()))

    return run


def same_artist_forms(p: str, q: str, u: str, v: str) -> bool:
    """Whether two forms of one kind certainly agree: equal attributes and like cores, or equal cores and like attributes."""
    if u == v:
        return near(p, q, core_slack(p, q))
    return p == q and bool(u) and not re.search("[~?]", u + v) and fits(u, v)


def may_mean(p: str, q: str, u: str, v: str) -> bool:
    """Whether a form with shortened or no attributes may be one with full or longer ones, or one that has in full what
    it shortens."""
    return near(p, q, min(1, core_slack(p, q))) and (fits(u, v) or crosses(u, v))


def crosses(u: str, v: str) -> bool:
    """Whether the attributes of two duos can be one, each in full where the other is shortened."""
    a, b = u.split(), v.split()
    either = lambda x, y: _fits(x, y) or _fits(y, x)
    return len(a) == len(b) == 2 and any(all(map(either, a, z)) for z in (b, b[::-1]))


def united(attributes: list[str]) -> set[str]:
    """Attributes that none of some attributes of one artist has, but all together have: for each member of a duo the
    full name, where one row gives this and another that. Nothing where the rows leave it open."""
    slots = [a.split() for a in attributes]
    out: set[str] = set()
    for x in slots:
        for y in slots:
            if len(x) != 2 or len(y) != 2 or x >= y:
                continue
            for z in (y, y[::-1]):
                best = [p if p[0] == "=" else q for p, q in zip(x, z)]
                if all(m[0] == "=" for m in best) and all(_fits(*sorted((p, q), key=lambda m: m[0] == "=")) for p, q in zip(x, z)):
                    out.add(" ".join(sorted(best)))
    return out - set(attributes)


def _richer(group: pa.Table) -> pa.Table:
    """New forms of one profile: its cores with all its full attributes, its own and united ones."""
    profile = group.select(["profile"]).slice(0, 1)["profile"].to_pylist()
    have = set(zip(*(group[c].to_pylist() for c in ("kind", "core", "attributes"))))
    out: set[tuple[str, str, str]] = set()
    for kind in {k for k, *_ in have} - {"b"}:
        own = sorted({a for k, _, a in have if k == kind})
        full = {a for a in own if not re.search("[~?]", a)} or (united(own) if kind == "d" else set())
        out |= {(kind, c, a) for c in {c for _, c, _ in have} for a in full}
    new = sorted(out - have)
    return pa.table([pa.array(profile * len(new), pa.int64()), *(pa.array([n[k] for n in new], pa.string()) for k in range(3))], ["profile", "kind", "core", "attributes"])


def _pairs(fresh: DataFrame, blocks: DataFrame, first: bool) -> tuple[DataFrame, DataFrame]:
    """(certain links, possible meanings) of fresh blocks and all blocks; (a, b) of forms. A crowded block of full forms
    is cut by a salt, and the forms that may mean one of them go to each part."""
    side = lambda df, s: df.select("block", *[F.col(c).alias(f"{c}_{s}") for c in ("kind", "core", "attributes")], F.col("form").alias(s))
    columns = ["a", "b", "core_a", "core_b", "attributes_a", "attributes_b"]
    strict = side(fresh.where("strict"), "a").join(side(blocks.where("strict"), "b"), "block").where("kind_a = kind_b and a < b" if first else "kind_a = kind_b and a <> b")
    certain = strict.select(*columns).distinct().mapInArrow(_check(same_artist_forms), "a bigint, b bigint")
    loose, new = blocks.where("not strict"), fresh.where("not strict")
    partial = f"not ({FULL})"
    crowded = loose.where(FULL).groupBy("block").count().where(f"count > {HOT_BLOCK}").select("block", F.ceil(F.col("count") / HOT_BLOCK).cast("int").alias("parts"))

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        left = side(left.where(partial), "a").join(crowded, "block", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        right = side(right.where("kind <> 'b'"), "b").join(crowded, "block", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        return left.join(right, ["block", "part"]).where("(kind_a = 'b' or kind_a = kind_b) and a <> b").select(*columns)

    both = meet(new, loose) if first else meet(new, loose).unionByName(meet(loose, new))
    return certain, both.distinct().mapInArrow(_check(may_mean), "a bigint, b bigint")


def resolve(df: DataFrame, *, key: str = "credit_id", name: str = "artist") -> DataFrame:
    """(`key`, artist_class): rows that name the same person, duo or group share a class, named by its smallest form.

    Null names and names without letters are in no class. Equal names are always one class. Keys are kept as they are;
    other columns are dropped; an empty table gives no rows. Profiles are merged until nothing changes any more: a link
    is never taken back and forms are made of words that are there, so this ends.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.col(name).alias("name")).where(F.col("name").isNotNull())
    names = materialize(rows.select("name").distinct(), "names")
    shared = spark.sparkContext.broadcast(lexicon_of(names))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shared.value
        for b in batches:
            parsed = [lexicon.parse(n) for n in b.column("name").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("name"), *(pa.array([p[i] for p in parsed], pa.string()) for i in range(3))], ["name", "kind", "core", "attributes"])

    form = F.xxhash64("kind", "core", "attributes").alias("form")
    columns = [c.split()[0] for c in FORM.split(", ")]
    parsed = names.mapInArrow(parse, "name string, kind string, core string, attributes string").where("core <> ''")
    parsed = materialize(parsed.withColumn("form", form), "parsed")
    # every form with the profile it belongs to; forms that unite what others have are added to those that were typed
    forms = materialize(parsed.select(*columns).distinct().withColumn("profile", F.col("form")), "forms")
    blocks = fresh = materialize(forms.select(*columns).mapInArrow(_keys, f"{FORM}, block string, strict boolean"), "blocks")
    links, could = _pairs(fresh, blocks, True)
    links, could = materialize(links, "links"), materialize(could, "could")
    if not links.limit(1).count():
        links = materialize(_meanings(forms, could), "links")
    while links.limit(1).count():
        merged = components(links)
        old, forms = forms, materialize(forms.join(merged, forms["profile"] == merged["node"], "left").select(*columns, F.coalesce("component", "profile").alias("profile")), "forms")
        # profiles that have just merged unite what they have; what is new enters blocking, against all
        changed = forms.join(merged.select(F.col("component").alias("profile")).distinct(), "profile", "left_semi")
        richer = materialize(changed.groupBy("profile").applyInArrow(_richer, "profile bigint, kind string, core string, attributes string").select(form, "profile", "kind", "core", "attributes"), "richer")
        new = materialize(richer.join(forms.select("form"), "form", "left_anti").groupBy(*columns).agg(F.min("profile").alias("profile")), "new")
        discard(old, links)
        # a profile that comes to have a form of another one is the same artist
        same = richer.join(forms.select("form", F.col("profile").alias("its")), "form").unionByName(richer.join(new.select("form", F.col("profile").alias("its")), "form"))
        links = same.where("its <> profile").select(F.col("profile").alias("a"), F.col("its").alias("b"))
        if new.limit(1).count():
            fresh = materialize(new.select(*columns).mapInArrow(_keys, f"{FORM}, block string, strict boolean"), "fresh")
            old, forms = forms, materialize(forms.unionByName(new.select(*forms.columns)), "forms")
            old_blocks, blocks = blocks, materialize(blocks.unionByName(fresh), "blocks")
            certain, possible = _pairs(fresh, blocks, False)
            old_could, could = could, materialize(could.unionByName(possible), "could")
            of = lambda s: forms.select(F.col("form").alias(s), F.col("profile").alias(f"p{s}"))
            links = links.unionByName(certain.join(of("a"), "a").join(of("b"), "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
            links = materialize(links.unionByName(_meanings(forms, could)).distinct(), "links")
            discard(old, old_blocks, old_could, fresh)
        else:
            links = materialize(links.unionByName(_meanings(forms, could)).distinct(), "links")
        discard(richer, new)
    classes = parsed.select("name", "form").join(forms.select("form", F.col("profile").alias("artist_class")), "form")
    return rows.join(classes, "name").select(F.col("k").alias(key), "artist_class")


def _meanings(forms: DataFrame, could: DataFrame) -> DataFrame:
    """(a, b): open profiles, which have no full form, and the only artist that all their forms may mean."""
    full = ~F.col("attributes").rlike("[~?]")
    profile = lambda s: forms.select(F.col("form").alias(s), F.col("profile").alias(f"p{s}"), F.col("core").alias(f"core_{s}"))
    open_ = could.join(profile("a"), "a").join(profile("b").join(forms.select(F.col("form").alias("b"), "kind", "attributes"), "b"), "b").where("pa <> pb")
    open_ = open_.select("pa", "pb", "kind", "attributes", (F.col("core_a") == F.col("core_b")).alias("exact"))
    whole = forms.where(FULL).groupBy(F.col("profile").alias("pb")).agg(F.min("attributes").alias("canon"))
    open_ = materialize(open_.join(whole.select(F.col("pb").alias("pa")), "pa", "left_anti").join(whole, "pb", "left").distinct(), "open")
    # full forms come first, where there are none a longer shortened form; then those with the very same core
    rank = F.struct(~full, ~F.col("exact"))
    best = open_.join(open_.groupBy("pa").agg(F.min(rank).alias("first")), "pa").where(rank == F.col("first"))
    # an open profile means one artist if all that is left says the same
    meaning = F.when(full, F.concat_ws(" ", "kind", F.coalesce("canon", "attributes"))).otherwise(F.col("pb").cast("string"))
    only = best.groupBy("pa").agg(F.min(meaning).alias("low"), F.max(meaning).alias("high")).where("low = high").select("pa")
    return best.join(only, "pa").select(F.col("pa").alias("a"), F.col("pb").alias("b"))


def same_artist(classes: DataFrame, key: str = "credit_id") -> DataFrame:
    """(a, b), a < b, of all rows in one class."""
    return class_pairs(classes.select("artist_class", F.col(key).alias("id")), ["artist_class"])


def with_links(classes: DataFrame) -> DataFrame:
    """`classes` with `links`, the number of other rows of the class."""
    return classes.join(classes.groupBy("artist_class").agg((F.count("*") - 1).alias("links")), "artist_class")
