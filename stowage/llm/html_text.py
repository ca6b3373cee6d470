"""HTML extraction by maximum-scoring subsequence.

A page becomes a sequence of words and tags. A word's weight is the log odds that its block is content, given the tags
and class words of the elements around it: a logistic fit on blocks of pages that mark their article. Tags weigh
negative, by how much oftener they stand outside articles. One linear scan (Kadane) finds the contiguous region of the
largest sum; its blocks of positive weight are the text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column

#: A comment, a raw-text element, a tag, or text up to the next tag.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|select|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
#: Elements that start and end a block of text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and class words that name a kind of text which is never the article's: menus, headers, footers, sidebars,
#: notices, adverts, forms, comments. They start with a negative weight, which labelled pages outside articles adjust.
KINDS = frozenset("nav header footer aside form head title button menu dialog".split())
KIND_WORDS = frozenset("menu nav navbar navigation breadcrumb breadcrumbs topbar header footer sidebar complementary contentinfo notice cookie cookies consent gdpr popup modal ad ads advert adverts advertisement banner promo sponsor sponsored form search login newsletter subscribe signup comment comments reply replies respond disqus".split())
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that hold the content; their classes say what the page has, not what they are.
HOLDERS = frozenset("html body main".split())
CLOSES = frozenset("p li dd dt td th tr option".split())
SPACE = re.compile(r"\s+")
ARTICLE, OUTSIDE = "article", "#outside"
#: Weights that the fit starts from and is drawn to.
PRIOR_KIND, PRIOR_ARTICLE, PRIOR_OUTSIDE, PRIOR_ANY = -6.0, 3.0, -6.0, 1.0
_contexts: dict = {}


def context_of(outer: tuple[str, ...], name: str, attributes: str) -> tuple[str, ...]:
    """What is known of a block: tags of the elements it stands in, and their class, id and role words as ``.word``."""
    keys = {*outer, "article header" if name == "header" and ARTICLE in outer else name}  # an article's own heading block
    if name not in HOLDERS and attributes:
        for m in ATTRIBUTE.finditer(attributes):
            for value in (m[1] or m[2] or m[3] or "").lower().split():
                if not value.startswith(("has-", "with-", "no-")):
                    keys.update("." + w for w in re.split(r"[-_:]+", value) if w and not w.isdigit())
    found = tuple(sorted(keys))
    return _contexts.setdefault(found, found) if len(_contexts) < 100_000 else found


def is_kind(key: str) -> bool:
    """Whether a tag or class word names a kind of text that no article holds."""
    return key in KINDS or key[:1] == "." and key[1:] in KIND_WORDS


def tokens(page: str):
    """(kind, name or text, context) with kind ``open``, ``close`` or ``text``."""
    stack: list[tuple[str, tuple]] = []
    for m in TOKEN.finditer(page):
        whole = m[0]
        if m[3] is None:
            if whole[0] != "<" or whole == "<":
                yield "text", whole, stack[-1][1] if stack else ()
            continue
        name = m[3].lower()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in CLOSES and any(x[0] in ("article", "main", "div", "section", "nav", "footer", "aside", "header", "body") for x in stack[k + 1 :]):
                        break
                    del stack[k:]
                    break
            yield "close", name, stack[-1][1] if stack else ()
            continue
        if name in CLOSES and stack and stack[-1][0] == name:
            stack.pop()  # <p> ends an open <p>
        inner = context_of(stack[-1][1] if stack else (), name, m[4] or "")
        if name not in VOID and not (m[4] or "").endswith("/"):
            stack.append((name, inner))
        yield "open", name, inner


def blocks(page: str):
    """The page as blocks of running text: (text, words, tags before it by name, context).

    Inline elements don't part a block; it has the context of the first text in it, but for text of another kind."""
    out, parts, tags, inside, kind = [], [], [], (), False

    def close():
        nonlocal parts, tags
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            out.append((text, text.count(" ") + 1, tags, inside))
            tags = []
        parts = []

    for token, what, context in tokens(page):
        if token == "text":
            other = context is not inside and any(map(is_kind, context))
            if what.strip() and other != kind and "".join(parts).strip():
                close()
            if what.strip() and not "".join(parts).strip():
                inside = context
            if what.strip():
                kind = any(map(is_kind, inside)) if context is not inside else other or any(map(is_kind, context))
            parts.append(what)
        else:
            if what in BLOCKS:
                close()
            elif what == "br":
                parts.append(" ")
            tags.append(("/" if token == "close" else "") + what)
    close()
    return out


def prior(key: str) -> float:
    return PRIOR_KIND if is_kind(key) else PRIOR_ARTICLE if key == ARTICLE else PRIOR_OUTSIDE if key == OUTSIDE else 0.0


def weights_of(keys, weights: dict) -> float:
    """Weight of each word of a block with these keys."""
    known = weights["keys"]
    return min(max(weights["any"] + sum(known[k] if k in known else prior(k) for k in keys), -6.0), 4.0)


def fitted(samples: Counter, least: int = 3) -> tuple[dict, float]:
    """Logistic weights of keys, and the constant, from counts of (keys, is content); rare keys keep their prior.

    Each block also counts without the marks of the article, so that other evidence is learned and pages that mark none
    are read by it. The squared distance from the priors is penalised."""
    seen = Counter()
    for (keys, _), n in samples.items():
        seen.update(dict.fromkeys(keys, n))
    names = sorted(k for k, n in seen.items() if n >= least)
    place = {k: i for i, k in enumerate(names)}
    rows, y, n = [], [], []
    for (keys, content), count in sorted(samples.items()):
        for kept in {keys, tuple(k for k in keys if k not in (ARTICLE, OUTSIDE))}:
            row = np.zeros(len(names) + 1)
            row[[place[k] for k in kept if k in place]] = 1
            row[-1] = 1
            rows.append(row)
            y.append(content)
            n.append(count)
    start = np.array([*map(prior, names), PRIOR_ANY])
    if not rows:
        return {}, PRIOR_ANY
    x, y, n, w = np.array(rows), np.array(y, float), np.array(n, float), start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + np.eye(len(w)), x.T @ (n * (y - p)) - (w - start))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1])


def learn(pages: DataFrame, rows: int = 500) -> dict:
    """Weights from at most ``rows`` pages that mark their content with ``<article>``, none over 200,000 characters.

    The sample (least hash of the page) is the documented bound of what reaches the driver. Blocks in an article are
    content, others aren't; a block of another kind inside an article (an advert, a comment) is neither. Null pages have
    no part; without any marked page the priors are the weights."""
    sample = pages.where(F.col("html").contains("<article") & (F.length("html") < 200_000)).select("page_id", "html", F.xxhash64("page_id", "html").alias("h"))
    least = sample.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]  # hashes are compared, pages stay where they are
    sample = sample.where(F.col("h") <= (least if least is not None else 0)).orderBy("h", "page_id").limit(rows).select("html").collect()
    return weights_from([r.html for r in sample])


def weights_from(pages: list[str]) -> dict:
    samples, inside, outside = Counter(), Counter(), Counter()
    for page in pages:
        found = blocks(page)
        for _, _, tags, keys in found:
            content = ARTICLE in keys
            if content and any(map(is_kind, keys)):
                continue
            samples[keys if content else (*keys, OUTSIDE), content] += 1
            (inside if content else outside).update(tags)
    known, constant = fitted(samples)
    total_in, total_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    odds = {t: math.log((inside[t] + 0.5) / total_in) - math.log((outside[t] + 0.5) / total_out) for t in sorted({*inside, *outside})}
    return {"keys": known, "any": constant, "tags": {t: max(min(v, -0.05), -3.0) for t, v in odds.items()}, "tag": -0.1}


PRIORS = {"keys": {}, "any": PRIOR_ANY, "tags": {}, "tag": -0.1}


def extract(page: str, weights: dict) -> str:
    """Text of the best region; blocks in it whose words weigh negative are left out."""
    found = blocks(page)
    marked = any(ARTICLE in keys and not any(map(is_kind, keys)) for _, _, _, keys in found)
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    known, other = weights["tags"], weights["tag"]
    values, cache = [], {}
    for k, (_, n, tags, keys) in enumerate(found):
        own = cache.get(keys)
        if own is None:
            own = cache[keys] = weights_of((*keys, OUTSIDE) if marked and ARTICLE not in keys else keys, weights)
        values.append(own)
        article = marked and ARTICLE in keys
        # an article is one: neither the tags between its blocks nor an advert in it part what is before from what is after
        gap = 0.0 if article else sum(known.get(t, other) for t in tags)
        value = max(n * own, 0.0) if article else n * own
        if total + gap <= 0:
            total, start = 0.0, k
            gap = 0.0
        total += gap + value
        if total > best:
            best, low, high = total, start, k + 1
        if total <= 0:
            total, start = 0.0, k + 1
    return "\n".join(b[0] for b, v in zip(found[low:high], values[low:high], strict=True) if v > 0)


def main_text(pages: DataFrame, weights: dict | None = None) -> DataFrame:
    """``pages(page_id, url, html)`` -> page_id, url, text, n_chars, one row a page.

    Null and empty pages have an empty text; so have pages whose words all weigh negative. Repeated pages are read each
    for itself; other columns are not read. Without weights they are learned from ``pages``."""
    weights = learn(pages) if weights is None else weights

    def run(batches):
        for batch in batches:
            texts = [extract(t.as_py(), weights) for t in text_column(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
