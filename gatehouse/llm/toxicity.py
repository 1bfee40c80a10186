"""Toxicity by a lexicon trie, Levenshtein automata and context windows: op3 and a stage of the pipeline."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common

#: Labelled rows of each class, by smallest hash of their id, on which lexicon and weights are fitted.
FIT_ROWS = 3000
#: Terms in the lexicon at most; shortest and longest stem; share of a longer stem's support that must remain.
TERMS, STEM, STEM_MOST, REMAINS = 2000, 3, 12, 0.9
#: Least support (different contexts in toxic texts) of a term: a number and a share of the toxic rows.
SUPPORT, SUPPORT_SHARE = 3, 0.01
#: Share of a term's weighted support that must come from toxic texts, and by how many nats its counts must speak against chance; thousands of words are tried.
PRECISION, EVIDENCE = 0.85, 12.0
#: Log odds that give a term its full weight.
FULL = 5.0
#: Words before and behind a match in which quotation marks and other matches count.
WINDOW = 6
#: Tokens whose matches a task remembers at most.
REMEMBERED = 400_000

WORDS = re.compile(r"[^\W_]+")
#: The marks that close each opening mark; a mark may open in one language and close in another.
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "›": "‹", "‘": "’"}
MARKS = re.compile("[%s]" % "".join(sorted(set("".join(QUOTES) + "".join(QUOTES.values())))))


def edits_for(length: int) -> int:
    """Edits allowed in a term of so many characters."""
    return 0 if length < 4 else 1 if length < 8 else 2


class Trie:
    """Lexicon terms as a trie; a term is a word or, with a stem flag, the beginning of one. With any_first a word's first letter may be wrong too."""

    def __init__(self, terms: list[tuple[str, bool]], any_first: bool = False) -> None:
        self.any_first, self.longest = any_first, max((len(t[0]) for t in terms), default=0)
        self.next: list[dict[str, int]] = [{}]
        self.end: list[tuple[str, bool] | None] = [None]
        #: Bit sets of terms: those below each node, those that a part at a place leaves possible, those that a word's length does.
        self.below, parts = [0], {}
        self.of_length = [0] * (self.longest + edits_for(self.longest) + 2)
        for i, (term, stem) in enumerate(terms):
            at, most, own = 0, edits_for(len(term)), 1 << i
            # Of a term in most + 1 parts one is left whole by so many edits, moved by as many places at most.
            for k in range(most + 1):
                a, b = k * len(term) // (most + 1), (k + 1) * len(term) // (most + 1)
                for place in range(max(0, a - most), a + most + 1):
                    held = parts.setdefault((place, place + b - a), {})
                    held[term[a:b]] = held.get(term[a:b], 0) | own
            for n in range(len(term) - most, len(self.of_length) if stem else len(term) + most + 1):
                self.of_length[n] |= own
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.end.append(None)
                    self.below.append(0)
                at = self.next[at][c]
                self.below[at] |= own
            self.end[at] = (term, stem or bool(self.end[at] and self.end[at][1]))
        self.parts = [(a, b, held) for (a, b), held in sorted(parts.items())]

    def match(self, word: str) -> tuple[str, int] | None:
        """The term nearest to a word and its edits: an exact word or stem, else the word's Levenshtein automaton run along the trie."""
        at = 0
        found = None
        for k, c in enumerate(word):
            at = self.next[at].get(c, -1)
            if at < 0:
                break
            if self.end[at] and (self.end[at][1] or k == len(word) - 1):
                found = self.end[at][0], 0
        return found or self._fuzzy(word)

    def _fuzzy(self, word: str) -> tuple[str, int] | None:
        """States of the automaton are bit sets of reached places in the word, one for each number of edits so far.

        A word is matched at its end, a stem at any place. Places that no term reaches aren't held, nor
        are branches entered whose terms differ from the word in every part or in too much length.
        """
        n, most = len(word), edits_for(len(word) + 1)
        first = 0 if self.any_first else self.next[0].get(word[0]) if word else None
        if not most or first is None or n < 4:
            return None
        possible = 0
        for a, b, held in self.parts:
            possible |= held.get(word[a:b], 0)
        possible &= self.of_length[min(n, len(self.of_length) - 1)]
        if not possible:
            return None
        masks: dict[str, int] = {}
        for i, c in enumerate(word[: self.longest + most]):
            masks[c] = masks.get(c, 0) | 1 << i
        full, best = (1 << (min(n, self.longest + most) + 1)) - 1, None
        start = [((1 << (e + 1)) - 1) << (first != 0) & full for e in range(most + 1)]
        stack = [(first, start)]
        while stack:
            at, states = stack.pop()
            term = self.end[at]
            if term:
                for e in range(1, min(most, edits_for(len(term[0]))) + 1):
                    if states[e] if term[1] else states[e] >> n & 1:
                        if best is None or (e, term[0]) < (best[1], best[0]):
                            best = term[0], e
                        break
            for c, to in self.next[at].items():
                if not self.below[to] & possible:
                    continue
                mask = masks.get(c, 0)
                moved = [(states[0] & mask) << 1]
                for e in range(1, most + 1):
                    # a right letter; a wrong one; one too many in the term; one too many in the word
                    s = (states[e] & mask) << 1 | states[e - 1] << 1 | states[e - 1] | moved[e - 1] << 1
                    moved.append(s & full)
                if any(moved):
                    stack.append((to, moved))
        return best


class Matcher(dict):
    """Weight and edits of the match of each token, forgotten when there are too many. Terms are (term, whether it is a stem, weight, and where it is another one, the weight of its misspellings); ordinary words are nobody's misspellings."""

    def __init__(self, terms: list[tuple], ordinary: frozenset[str] = frozenset()) -> None:
        self.trie = Trie([t[:2] for t in terms], any_first=True)
        self.weights = {t: (w, *near, w)[:2] for t, _, w, *near in terms}
        self.ordinary = ordinary

    def __missing__(self, word: str):
        found = self.trie.match(word)
        if found and found[1] and (word in self.ordinary or not self.weights[found[0]][1]):
            found = None
        found = found and (self.weights[found[0]][found[1] > 0], found[1])
        if len(word) < 64:  # longer ones hardly come again
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


def quotations(text: str) -> list[tuple[int, int]]:
    """Where quotations begin and end: an opening mark and the next mark that closes it. A mark between two letters or digits is an apostrophe; a straight one opens only before a letter or digit, behind a space or at the beginning of the text."""
    found, opened = [], None
    for m in MARKS.finditer(text):
        mark, at = m.group(), m.start()
        before, behind = text[at - 1 : at] if at else "", text[at + 1 : at + 2]
        if before.isalnum() and behind.isalnum():
            continue
        opens = mark in QUOTES and (mark != '"' or (not before.strip() and behind.isalnum()))
        if opened is not None and mark in QUOTES[text[opened]] and (mark != '"' or not opens):
            found.append((opened, at))
            opened = None
        elif opens:
            opened = at
    return found


def _quoted(text: str, hits: list[int]) -> set[int]:
    """Those of the numbered words that stand in a quotation, at most WINDOW words behind its first word and before its last."""
    around = quotations(text)
    if not around:
        return set()
    starts, begins = [m.start() for m in WORDS.finditer(text)], [a for a, _ in around]
    out = set()
    for i in hits:
        a, b = around[max(0, bisect_right(begins, starts[i]) - 1)]
        if a < starts[i] < b and i - bisect_right(starts, a) <= WINDOW and bisect_right(starts, b) - 1 - i <= WINDOW:
            out.add(i)
    return out


def features(text: str, matcher: Matcher) -> tuple[float, float, int, int, int, int]:
    """Context-window scores of exact and of misspelled matches, and how many words there are and how many matches are exact, misspelled, quoted.

    A match counts its term's weight, a half or a third of it with one or two edits, a quarter of it
    within quotation marks; other matches in the window, outside quotation, add half of it each, up to all.
    """
    low = text.lower()
    words = WORDS.findall(low)
    hits = [(i, m) for i, m in enumerate(map(matcher.__getitem__, words)) if m]
    if not hits:
        return 0.0, 0.0, len(words), 0, 0, 0
    quoted = _quoted(low, [i for i, _ in hits])
    exact = fuzzy = 0.0
    places = [i for i, m in hits if i not in quoted and m[0] > 0]
    lows = np.searchsorted(places, [i - WINDOW for i, _ in hits])
    highs = np.searchsorted(places, [i + WINDOW for i, _ in hits], "right")
    for (i, (own, edits)), a, b in zip(hits, lows.tolist(), highs.tolist(), strict=True):
        weight = own * (0.25 if i in quoted else 1.0 + 0.5 * min(2, b - a - 1))
        if edits:
            fuzzy += weight / (1 + edits)
        else:
            exact += weight
    n_exact = sum(not m[1] for _, m in hits)
    return exact, fuzzy, len(words), n_exact, len(hits) - n_exact, len(quoted)


def _occurrences(terms: dict[str, bool] | None = None):
    """One row for each text and each of its words: a hash of the neighbours of one of its occurrences, the smallest. With terms, those words and stems alone count."""

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = max(map(len, terms), default=0) if terms else 0
        for batch in batches:
            words, contexts, toxic = [], [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = ["", *WORDS.findall((text or "").lower()), ""]
                least: dict[str, int] = {}
                for a, w, b in zip(found, found[1:], found[2:], strict=False):
                    own = [w] if terms is None else [w[:k] for k in range(STEM, min(len(w), longest) + 1) if terms.get(w[:k]) or (k == len(w) and w in terms)]
                    if own:
                        context = zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass"))
                        for term in own:
                            least[term] = min(context, least.get(term, context))
                words += least
                contexts += least.values()
                toxic += [label] * len(least)
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "context": pa.array(contexts, pa.int64()), "toxic": pa.array(toxic, pa.int32())})

    return occur


def _supports(sample: DataFrame, terms: dict[str, bool] | None = None) -> DataFrame:
    """(word, bad, good): in how many different neighbourhoods toxic and clean texts have a word."""
    seen = sample.select("text", "toxic").mapInArrow(_occurrences(terms), "word string, context long, toxic int").groupBy("word", "context").agg(F.max("toxic").alias("toxic"))
    return seen.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))


def lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> list[tuple[str, bool, float]]:
    """Terms (whether they are stems, and their weights by log odds) that tell toxic texts of a bounded labelled sample.

    A word's support is the number of different neighbourhoods it has, one a text, so that neither
    copies of a text nor a text that repeats a word make terms. Stems that may have enough support, by
    the sums of the words they begin, are counted the same way; a stem grows while it keeps its support
    and becomes a word where one word has it.
    """
    if not n_toxic or not n_clean:
        return []
    words = common.checkpoint(_supports(sample))
    least = max(SUPPORT, SUPPORT_SHARE * n_toxic)
    share, both = n_toxic / (n_toxic + n_clean), F.col("bad") + F.col("good")
    evidence = F.col("bad") * F.log(F.greatest("bad", F.lit(1)) / both / share) + F.col("good") * F.log(F.greatest("good", F.lit(1)) / both / (1 - share))
    sure = (F.col("bad") >= least) & (evidence >= EVIDENCE) & (F.col("bad") * n_clean >= PRECISION * (F.col("bad") * n_clean + F.col("good") * n_toxic))
    odds = F.log((F.col("bad") + 0.5) / (n_toxic + 1) / ((F.col("good") + 0.5) / (n_clean + 1)))
    weight = F.least(odds / FULL, F.lit(1.0)).alias("weight")
    whole, weights = {}, {}
    for r in words.where(sure & (F.length("word") >= STEM)).orderBy(F.desc("bad"), "word").limit(TERMS).select("*", weight).collect():
        whole[r["word"]], weights[r["word"]] = r["bad"], r["weight"]
    longest = F.least(F.length("word"), F.lit(STEM_MOST))
    stems = words.where(F.length("word") >= STEM).select("bad", "good", F.explode(F.transform(F.sequence(F.lit(STEM), longest), lambda k: F.substring("word", F.lit(1), k))).alias("stem"))
    stems = stems.groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    likely = {r["stem"]: True for r in stems.where(sure).orderBy(F.desc("bad"), "stem").limit(STEM_MOST * TERMS).collect()}
    held, stem_weights = {}, {}
    for r in _supports(sample, likely).where(sure).select("*", weight).collect() if likely else []:
        held[r["word"]], stem_weights[r["word"]] = r["bad"], r["weight"]
    terms: dict[str, bool] = dict.fromkeys(whole, False)
    longer: dict[str, list[str]] = {}
    for stem in held:
        longer.setdefault(stem[:-1], []).append(stem)
    for stem, bad in held.items():
        if stem[:-1] in held:
            continue  # grown from a shorter one
        while True:
            heir = max(longer.get(stem, []), key=lambda s: held[s], default=None)
            if heir is None or held[heir] < REMAINS * bad - 1:
                break
            stem = heir
        if max((n for w, n in whole.items() if w.startswith(stem)), default=0) < REMAINS * bad - 1:
            terms[stem], weights[stem] = True, stem_weights[stem]
    # Words that a stem begins stay for their own misspellings, behind the others where there are too many.
    begun = {w for w in whole if not terms[w] and any(terms.get(w[:k]) for k in range(STEM, len(w)))}
    return [(t, is_stem, weights[t]) for t, is_stem in sorted(terms.items(), key=lambda x: (x[0] in begun, x))][:TERMS]


def _logs(exact: float, fuzzy: float, n_words: int) -> tuple[float, ...]:
    return 1.0, math.log1p(exact + fuzzy), math.log1p(n_words)


def _weights(rows: list[tuple[float, float, int, int]]) -> tuple[float, ...]:
    """Logistic regression on the logarithms of the lexical score, exact and misspelled matches together, and of the number of words, by Newton steps with a small ridge; the score never speaks for a text."""
    x = np.array([_logs(*r[:3]) for r in rows])
    y = np.array([r[3] for r in rows], float)
    balance = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(3)
    ridge = np.diag([1e-3, 0.1, 0.1]) * math.sqrt(len(y))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (balance * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (balance * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1])), float(w[2])


def _misspelled(terms: list[tuple]):
    """One row for each text and word that is near a term, with the term."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Matcher(terms).trie
        known: dict[str, str | None] = {}
        for batch in batches:
            found, near, toxic = [], [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = set(WORDS.findall((text or "").lower()))
                for word in words - known.keys():
                    match = trie.match(word)
                    known[word] = match[0] if match and match[1] else None
                own = [w for w in words if known[w]]
                found += own
                near += [known[w] for w in own]
                toxic += [label] * len(own)
            yield pa.RecordBatch.from_pydict({"word": pa.array(found, pa.string()), "term": pa.array(near, pa.string()), "toxic": pa.array(toxic, pa.int32())})

    return find


def _with_misspellings(sample: DataFrame, terms: list[tuple[str, bool, float]]) -> tuple[list[tuple], frozenset[str]]:
    """terms with the weights of their misspellings, the term's own or 0, and the ordinary words.

    Ordinary is what clean texts of the sample hold near a term. Words that only one text has tell how a word
    not seen before fares: a term near any such of a clean text is too near to ordinary words for its
    misspellings to tell, and these weigh 0.
    """
    seen = sample.select("text", "toxic").mapInArrow(_misspelled(terms), "word string, term string, toxic int").groupBy("word", "term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    # Words near a term, of a bounded sample.
    rows = seen.where("bad < n").collect()
    singles = {r["term"] for r in rows if r["n"] == 1}
    return [(t, stem, w, 0.0 if t in singles else w) for t, stem, w in terms], frozenset(r["word"] for r in rows)


class Model:
    """A fitted lexicon, the ordinary words near it, and weights; small, so it goes to the tasks as it is."""

    def __init__(self, terms: list[tuple], weights: tuple[float, ...], ordinary: frozenset[str] = frozenset()) -> None:
        self.terms, self.weights, self.ordinary = terms, weights, ordinary

    def matcher(self) -> Matcher:
        return Matcher(self.terms, self.ordinary)

    def score(self, exact: float, fuzzy: float, n_words: int) -> float:
        z = sum(a * b for a, b in zip(self.weights, _logs(exact, fuzzy, n_words), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _measured(model: Model):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            found = [features(t or "", matcher) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"exact": pa.array([f[0] for f in found], pa.float64()), "fuzzy": pa.array([f[1] for f in found], pa.float64()), "n_words": pa.array([f[2] for f in found], pa.int64()), "toxic": batch.column("toxic").cast(pa.int32())})

    return measure


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model of labels.toxic, fitted on at most `rows` labelled documents of each class.

    The sample is the rows with the smallest hash of their id, not held out; of several labels of an id
    the largest counts, and every row of a repeated id is learnt from. Without rows of both classes, or
    without documents, every text scores 0.
    """
    common.small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    order = F.xxhash64(F.lit(3), "doc_id")
    ids = common.checkpoint(known.where("toxic = 1").orderBy(order, "doc_id").limit(rows).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(rows)))
    sample = common.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").repartition(docs.sparkSession.sparkContext.defaultParallelism), "toxicity-sample")
    counts = Counter({r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()})
    terms = lexicon(sample, counts[1], counts[0])
    if not terms:
        return Model([], (-30.0, 0.0, 0.0))
    terms, ordinary = _with_misspellings(sample, terms)
    # At most 2 * rows scores.
    measured = sample.select("text", "toxic").mapInArrow(_measured(Model(terms, (), ordinary)), "exact double, fuzzy double, n_words long, toxic int").collect()
    return Model(terms, _weights([(r["exact"], r["fuzzy"], r["n_words"], r["toxic"]) for r in measured]), ordinary)


def _scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            found = [features(t.as_py() or "", matcher) for t in batch.column("text")]
            values = [model.score(*f[:3]) for f in found]
            columns = [pa.array(values, pa.float64()), *[pa.array([f[k] for f in found], pa.int32()) for k in (3, 4, 5)]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "text"], *columns], [*[c for c in batch.schema.names if c != "text"], "score", "n_terms", "n_misspelled", "n_quoted"])
        common.spare()

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_terms, n_misspelled, n_quoted) of every whole text.

    Null and empty texts have no match and get the score of none. Repeated rows are scored each; a null
    doc_id stays null. An empty table gives no rows. Other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(model), "doc_id long, score double, n_terms int, n_misspelled int, n_quoted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels that aren't held out."""
    docs = common.table(spark, sf_dir, "documents")
    found = scored(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_terms", "n_misspelled", "n_quoted")


def _keeper(model: Model):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            mask = [model.score(*features(t.as_py() or "", matcher)[:3]) < 0.5 for t in batch.column("text")]
            yield batch.filter(pa.array(mask, pa.bool_()))
        common.spare()

    return keep


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model calls toxic; null and empty texts and null ids stay, repeated rows are judged each, an empty table stays empty. All columns are kept."""
    return docs.mapInArrow(_keeper(model), docs.schema)
