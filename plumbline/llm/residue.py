"""Template residue and error pages: character n-gram models over filler, notices and prose.

``residue_scores`` fits hashed character 4-gram models on all texts, slides likelihood-ratio windows over
each text and reports which share of it the windows of filler or of notices cover, and whether
an unfilled placeholder was localised. ``residue_records`` keeps the records to exclude.

Defined results: a null or blank text has coverage 0 and no placeholder, so it is never
excluded; repeated rows give repeated rows; an empty table gives an empty result; columns other
than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.runtime import ship

TABLE_BITS = 17
WINDOW = 28
#: Mean log likelihood ratio a window must reach.
WINDOW_LR = 0.9
#: Steps of a log likelihood ratio of 1 in the tables.
UNIT = 64
TEMPLATE_LR = 3.0
#: A 4-gram of the texts a round takes over counts so often at most; of more than ``PER_TEXTS`` texts, so often for each that many.
MOST_PER_GRAM, PER_TEXTS = 20, 1500
#: Share of a text that windows of filler and notices must cover for the whole text to count.
WHOLE_TEXT = 0.6
SLICE_BYTES = 1_000_000

#: Seeds: filler as typesetters, editors and office templates ship it; fixed values, extended by the rounds of ``Models``.
FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna
aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint
occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum. Lorem ipsum dolor sit
amet, consetetur sadipscing elitr, sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat.
Click or tap here to enter text. Click here to add text. Click to add title. Click to add notes. Click to edit text.
Type your text here. Type here to add text. Enter your text here. Add your text here. Insert text here. Your text goes here.
Write your summary here. Write something here. Add a description here. Add a short summary of the document in this box.
[Type the document title] [Type the abstract of the document here.] The abstract is typically a short summary of the
contents of the document. Type the sender address. Type the body of the letter here.
This is a sample page. This is sample text. This is dummy text. This is placeholder text. This is filler text used for layout.
This is a paragraph. This paragraph is a placeholder for the layout. Placeholder text. Placeholder for the body text.
Placeholder for a statement. Placeholder for an image. Sample document. Sample content. Body text. Headline. Body copy.
The text will follow. Text to come. Text to be supplied. Copy to follow. Content to follow. Details to follow. More to come.
This page is under construction. This content will be available soon. Check back soon. New content is coming soon.
This is a test. Test page. Testing, one, two, three. Please ignore. Please replace this text before publication.
Replace this text with your own. Delete this text before release. To be announced. To be determined. To be confirmed.
"""
#: Seeds: reason phrases of the HTTP standard and default pages of public servers, browsers and page builders; fixed values.
NOTICES = """
400 Bad Request. 401 Unauthorized. 402 Payment Required. 403 Forbidden. 404 Not Found. 405 Method Not Allowed.
406 Not Acceptable. 407 Proxy Authentication Required. 408 Request Timeout. 409 Conflict. 410 Gone. 429 Too Many Requests.
500 Internal Server Error. 501 Not Implemented. 502 Bad Gateway. 503 Service Unavailable. 504 Gateway Timeout.
Error 400. Error 403: access to the resource is forbidden. Error 404: the resource was not found on this server.
Error 500: the server encountered an error. Error 503: the service is unavailable. HTTP status 404. HTTP Error 500.
The requested URL was not found on this server. The requested resource is no longer available on this server and there
is no forwarding address. Please remove all references to this resource. You don't have permission to access this resource.
This server could not verify that you are authorized to access the document requested. The server encountered an internal
error or misconfiguration and was unable to complete your request. Please contact the server administrator and inform them
of the time the error occurred. The server is temporarily unable to service your request due to maintenance downtime or
capacity problems. Please try again later. The proxy server received an invalid response from an upstream server. The
gateway did not receive a timely response from the upstream server or application. The upstream host did not respond in
time. Server timeout waiting for the request from the client. The user has sent too many requests in a given amount of time.
Your browser sent a request that this server could not understand. The page you are looking for is temporarily unavailable.
The page you are looking for might have been removed, had its name changed, or is temporarily unavailable. The document you
requested could not be found or located. The page you asked for does not exist. The page you tried to open has been moved or
removed. We are sorry, but the page you requested was not found. Page not found. Sorry, we could not find that page. Oops!
That page can not be found. It looks like nothing was found at this location. Maybe try a search? Return to the home page.
Go back to the previous page. Go to the start page. Check the address for typing errors and reload the page.
Briefly unavailable for scheduled maintenance. Check back in a minute. The site is currently undergoing maintenance and will
be back soon. We are down for maintenance. Site offline. Service temporarily unavailable.
Access denied. Sorry, you are not allowed to access this page. You are not authorized to view this page. You must be logged in
to view this page. Please log in to continue. Sign in and try again. Your session has timed out. Your session has expired,
please sign in again. Your IP address has been blocked. Too many requests have come from your network address. Our systems
have detected unusual traffic from your computer network. Please show you are not a robot. Checking your browser before
accessing the site. Verify you are human by completing the action below. Please enable cookies. Request blocked.
Something went wrong. An unexpected error has occurred. An error occurred while processing your request. Contact the site
administrator or the help centre if the problem persists. Please contact the webmaster. Contact support.
You need to enable JavaScript to run this app. Please enable JavaScript to view this page. Please enable JavaScript to
continue using this application. JavaScript is required. JavaScript is disabled in your browser. JavaScript appears to be
disabled in your browser. For the best experience on our site, be sure to turn on JavaScript in your browser. This site
requires scripts to work. This page uses scripts; please turn on scripting in your browser to use it. Your browser does not
support scripts, or scripts are being blocked. Scripts are required to display this content. Allow active content to run.
If the page does not load, switch on scripts and refresh the page. Loading. Please wait. If you are not redirected, click here.
Request ID: 00a00a00. Reference number 00a00a00. Error code: 000. Skip to main content. Skip to content. Home. Menu. Search.
"""
_FIELDS = (
    "rate_low rate_high vote_count meeting_date chair_name prior_range title body city decision name date amount "
    "first_name last_name email company address value author summary year month day"
).split()


def _template_seeds() -> str:
    shapes = (
        "{{%s}}", "{{ %s }}", "{%% %s %%}", "<%%= %s %%>", "${%s}", "#{%s}", "[[%s]]", "%%%%%s%%%%", "@@%s@@",
        "%%(%s)s", "<<%s>>", "~%s~", "?%s?", "&lt;%s&gt;", "$%s$", "__%s__", "[insert %s here]", "[insert %s]",
        "[enter %s]", "[%s to be confirmed]", "(%s: tbd)", "%s here", "xxxx", "[xx]", "xx.xx", "tk tk", "mm/dd/yyyy",
        "______", "{0}",
    )
    out = []
    for shape in shapes:
        for field in _FIELDS:
            spoken = field.replace("_", " ") if " " in shape or "(" in shape else field
            out.append(shape % spoken if "%" in shape else shape)
    return " ".join(out)


_FIELD = r"[A-Za-z_][A-Za-z0-9_.]*"
PLACEHOLDER = re.compile(
    rf"""
    \{{\{{\s*{_FIELD}(?:\s[^{{}}\n]{{0,40}})?\s*\}}\}} | \{{%-?\s*{_FIELD}[^{{}}\n]{{0,40}}%\}} | <%[=-]?\s*{_FIELD}[^<>\n]{{0,40}}%>
  | [$\#]\{{\s*{_FIELD}\s*\}} | (?<![\w$\s]\s)\{{\d+\}} | (?<=\w\s)\{{\d+\}} | \[\[\s*[A-Za-z_]\w*\s*\]\]
  | %%[A-Za-z_]+%% | @@\w+@@ | %\([A-Za-z_]\w*\)[sd] | <<[A-Z][A-Z_]*>> | \$[A-Z][A-Z_]+\$ | (?<!\w)__[A-Z][A-Z_]*__(?!\w)
  | (?<!\w)~[a-z]{{3,}}(?:_[a-z]+)*~ | (?<!\w)\?[a-z]{{3,}}(?:_[a-z]+)*\? | &lt;[a-z_]+&gt; | <[a-z]+_[a-z_]+>
  | \[(?i:insert|enter|type|add)\s[^\]\n]{{1,60}}\] | \[[^\]\n]{{1,60}}\s(?i:to\ be\ (?:confirmed|determined|added|completed))\]
  | \((?i:[a-z_ ]{{2,40}}):\s*(?:TBD|TBC|TBA)\) | \b(?:[A-Z]{{3,}}\s){{1,3}}HERE\b | (?<!\w)[xX]{{4,}}(?!\w) | \bXX[./]XX\b
  | \[[Xx]{{2,}}\] | \bTK\ TK\b | \b(?:MM/DD|DD/MM)/YYYY\b | (?<=[A-Za-z:]{{2}}\s)_{{5,12}}(?!\w)
    """,
    re.X,
)

_FOLD = bytes(
    32 if c in (9, 10, 13, 160) else 48 if 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


def _buckets(raw: bytes) -> np.ndarray:
    """Table positions of the byte 4-grams of ``raw``."""
    folded = raw.translate(_FOLD)
    code = np.ndarray((len(folded) - 3,), "<u4", folded, strides=(1,)) * np.uint32(2654435761)
    code >>= np.uint32(32 - TABLE_BITS)
    return code


def _counts(raw: bytes) -> np.ndarray:
    return np.bincount(_buckets(raw), minlength=1 << TABLE_BITS).astype(np.float64) if len(raw) > 3 else np.zeros(1 << TABLE_BITS)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches of texts that are dealt with together, of about ``SLICE_BYTES``."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) < SLICE_BYTES):
            size += len(texts[end])
            end += 1
        yield start, end
        start = end


def _counts_of(texts: list[bytes]) -> np.ndarray:
    """Sum of the counts of each text between blanks, the same however the texts are dealt out."""
    out, pad = np.zeros(1 << TABLE_BITS), b"    "
    for start, end in _slices(texts):
        out += _counts(pad + pad.join(texts[start:end]) + pad)
        out[_buckets(pad)] -= 1
    return out


def _logp(counts: np.ndarray, spread: float = 0.15) -> np.ndarray:
    total = max(counts.sum(), 1.0)
    return np.log((1 - spread) * counts / total + spread / counts.size)


class Models:
    """Log likelihood ratios against natural prose in fixed-size tables of hashed 4-grams.

    Filler and notices are two models; a window is scored by their mixture, in ``UNIT`` steps. Texts
    that the first rounds find covered leave the prose model and join the class that covers them.
    """

    def __init__(self, prose: list[str], held: Callable[[Models | None, float], tuple[np.ndarray, int]] | None = None):
        """Fit on ``prose``, or on texts that lie elsewhere: ``held`` is ``taken_over`` of them."""
        texts = [t.encode() for t in prose]
        held = held or (lambda models, least: taken_over(models, least, texts))
        base = {"filler": _counts(FILLER.encode()), "notice": _counts(NOTICES.encode())}
        template = _counts(_template_seeds().encode())
        counts, size = held(None, 0.0)
        every, natural = counts[0], counts[0]
        for least in (0.25, 0.35, None):
            prose_logp = _logp(natural)
            logs = {k: _logp(c) for k, c in base.items()}
            mixed = np.logaddexp(logs["filler"], logs["notice"]) - np.log(2) - prose_logp
            self.filler_leads = logs["filler"] > logs["notice"]
            pair = np.stack([mixed, _logp(template) - prose_logp], 1) * UNIT
            self.pairs = np.ascontiguousarray(np.clip(np.round(pair), -2000, 2000).astype("<i2")).view("<i4").ravel()
            if not size or least is None:
                break
            found, _ = held(self, least)
            for name, own in zip(("filler", "notice"), found):
                base[name] = base[name] + np.minimum(own * min(1, PER_TEXTS / size), MOST_PER_GRAM)
            natural = every - found.sum(0)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Share covered by residue windows, the part of it that is filler, and whether a template window was found."""
        share, filler, template = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
        pad = b" " * (WINDOW + 4)
        for start, end in _slices(texts):
            part = texts[start:end]
            idx = _buckets(pad.join(part) + pad)
            lengths = np.array([len(t) for t in part])
            at = np.concatenate([[0], np.cumsum(lengths + len(pad))[:-1]])
            both = self.pairs[idx].view("<i2").reshape(-1, 2)
            t = both[:, 1]
            near = t[:-3] + t[1:-2] + t[2:-1] + t[3:]
            template[start + np.searchsorted(at, np.flatnonzero(near >= 4 * UNIT * TEMPLATE_LR), "right") - 1] = True
            sums = np.cumsum(both[:, 0], dtype=np.int32)
            hits = np.flatnonzero(sums[WINDOW:] - sums[:-WINDOW] >= WINDOW * UNIT * WINDOW_LR) + 1
            for d in np.unique(np.searchsorted(at, hits, "right") - 1):
                lo = at[d]
                own = hits[np.searchsorted(hits, lo) : np.searchsorted(hits, lo + lengths[d])] - lo
                marks = np.bincount(own, minlength=lengths[d] + WINDOW + 4)
                ends = np.bincount(own + WINDOW + 3, minlength=len(marks))[: len(marks)]
                covered = np.cumsum(marks - ends)[: lengths[d]] > 0
                share[start + d] = covered.mean() if lengths[d] else 0
                filler[start + d] = share[start + d] * self.filler_leads[idx[lo : lo + lengths[d]]][covered].mean() if covered.any() else 0
        return share, filler, template


def taken_over(models: Models | None, least: float, texts: list[bytes]) -> tuple[np.ndarray, int]:
    """4-gram counts, by class, of the texts that a round takes over as filler and as notices, and how many texts there are; of all texts without models."""
    if models is None:
        return _counts_of(texts)[None], len(texts)
    share, filler, _ = models.score(texts)
    taken, leads = (filler >= least) | (share >= 0.8), filler > share / 2
    return np.stack([_counts_of([texts[i] for i in np.flatnonzero(taken & own)]) for own in (leads, ~leads)]), len(texts)


def fit_models(df: DataFrame, id_col: str, text_col: str) -> Models:
    """Fit the models on all texts that are not blank, whole: one pass counts, one each round scores.

    Only sums of counts reach the driver, at most two tables of them a pass, however many texts there are.
    """
    spark = df.sparkSession
    ship(spark)
    text = F.col(text_col).cast("string")
    rows = df.select(text.alias("t")).where(F.length(F.trim(text)) > 0)
    width = 1 << TABLE_BITS

    def held(models: Models | None, least: float) -> tuple[np.ndarray, int]:
        shared = spark.sparkContext.broadcast(models)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, size = np.zeros(2 * width), 0
            for b in batches:
                counts, n = taken_over(shared.value, least, [t.encode() for t in b["t"]])
                total[: counts.size] += counts.ravel()
                size += n
            at = np.flatnonzero(total)
            yield pd.DataFrame({"at": np.append(at, 2 * width), "n": np.append(total[at], size).astype(np.int64)})

        sums = rows.mapInPandas(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(2 * width + 1)
        total[sums["at"].to_numpy()] = sums["n"].to_numpy()
        return total[:-1].reshape(2, width), int(total[-1])

    return Models([], held)


def judge(models: Models, texts: list[str]) -> dict[str, np.ndarray]:
    """Scores of ``texts``; a placeholder is decided exactly where a template window was localised."""
    share, filler, template = models.score([t.strip().encode() for t in texts])
    placeholder = np.array([bool(s and PLACEHOLDER.search(t)) for t, s in zip(texts, template)], bool)
    return {"share": share, "filler": filler, "placeholder": placeholder, "residue": placeholder | (share >= WHOLE_TEXT)}


def residue_scores(df: DataFrame, id_col: str = "fomc_id", text_col: str = "text_content") -> DataFrame:
    """(id, residue_share, filler_share, placeholder, residue) of each row; see the module's text."""
    models = df.sparkSession.sparkContext.broadcast(fit_models(df, id_col, text_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = judge(models.value, b["text"].fillna("").tolist())
            yield pd.DataFrame(
                {
                    "id": b["id"],
                    "residue_share": s["share"],
                    "filler_share": s["filler"],
                    "placeholder": s["placeholder"],
                    "residue": s["residue"],
                }
            )

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(
        run, f"id {kind}, residue_share double, filler_share double, placeholder boolean, residue boolean"
    )
    return out.withColumnRenamed("id", id_col)


def residue_records(df: DataFrame, id_col: str = "fomc_id", text_col: str = "text_content") -> DataFrame:
    """Ids of the records to exclude as template residue, filler, error page or script notice."""
    return residue_scores(df, id_col, text_col).where("residue").select(id_col)
