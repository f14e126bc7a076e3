"""Operator 6: URL filters, rules first and then a logistic regression.

The model hashes the character n-grams of host and path into weights trained by
gradient descent, with a bias, on the small labelled table below, which has nothing of
the pages judged (``held_out_accuracy`` measures it by folds). A rule fits its host and all
subdomains if the path starts with the rule's path; the longest rule wins.

Defined cases: a null url or one without ``://`` has empty host and path, matches no
rule and is judged by the model on no features, that is by its bias alone; repeated rows are judged
alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.textkernel import mix, utf8

#: (rule, verdict): fixed values of the task.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The labelled table: host and path of ordinary pages, and of pages of spam, gambling, pornography, fraud and link farms.
ALLOWED = (
    "en.wikipedia.org/wiki/Photosynthesis www.bbc.co.uk/news/science-environment-56837908 docs.python.org/3/library/asyncio.html github.com/torvalds/linux/blob/master/README "
    "stackoverflow.com/questions/11227809/why-is-processing-a-sorted-array-faster www.nature.com/articles/s41586-021-03819-2 arxiv.org/abs/1706.03762 www.nasa.gov/missions/artemis "
    "www.gutenberg.org/ebooks/1342 plato.stanford.edu/entries/kant www.who.int/news-room/fact-sheets/detail/diabetes ec.europa.eu/commission/presscorner www.loc.gov/collections/maps "
    "www.allrecipes.com/recipe/23600/worlds-best-lasagna www.britannica.com/animal/elephant-mammal developer.mozilla.org/en-US/docs/Web/HTML/Element/table www.metmuseum.org/art/collection "
    "www.lemonde.fr/planete/article/2023/05/04/climat www.spiegel.de/wissenschaft/natur/forscher-entdecken-neue-art elpais.com/cultura/2022-11-08/la-novela www.zeit.de/kultur/literatur/index "
    "blog.rust-lang.org/2023/06/01/release.html kubernetes.io/docs/concepts/workloads www.postgresql.org/docs/current/queries.html scipy.org/install www.khanacademy.org/math/algebra "
    "www.weather.gov/forecast/points library.harvard.edu/catalog/item/990012 www.mayoclinic.org/diseases-conditions/migraine/symptoms www.nhs.uk/conditions/asthma/treatment "
    "www.cityofboston.gov/parks/schedule school.oakdale.edu/students/handbook history.state.gov/milestones/1945-1952 gardening.example.org/tomatoes/when-to-plant "
    "forum.woodworking.example/threads/dovetail-joints m.newsroom.example/local/council-meeting-minutes www.railway-museum.example/visit/opening-hours blog.travelnotes.example/portugal/lisbon-walks "
    "shop.bookstore.example/authors/jane-austen support.printerworks.example/manuals/model-200 www.churchofsaintmary.example/events/concert physics.university.example/courses/mechanics/lecture-notes "
    "recipes.homekitchen.example/bread/sourdough-starter www.birdwatchers.example/species/kingfisher news.farmers.example/harvest/wheat-prices www.chessclub.example/openings/sicilian-defence "
    "linguistics.institute.example/papers/syntax/2019 www.marathon.example/results/2022/women astronomy.observatory.example/telescopes/mirror www.townhall.example/services/recycling "
    "data.statistics.example/population/census-2020 www.legalaid.example/tenants/rights music.conservatory.example/faculty/piano docs.spark.example/latest/sql-reference www.theatre.example/plays/hamlet "
    "www.seismology.example/earthquakes/map kids.science.example/volcano/experiment blog.bicycle.example/repair/chain www.riverside-hospital.example/departments/cardiology economics.review.example/inflation/history "
    "www.hiking.example/trails/alps/route-7 archive.newspaper.example/1969/07/21/moon www.library.example/catalogue/search museum.example/exhibitions/rome/mosaics wiki.software.example/index/install "
    "www.bakery.example/menu/rye-bread www.parliament.example/bills/education forum.linux.example/kernel/drivers www.veterinary.example/cats/vaccines magazine.photo.example/lenses/review "
    "www.fishing.example/lakes/trout blog.teacher.example/classroom/reading www.architecture.example/bridges/suspension www.oceanography.example/currents/gulf-stream www.insurance.example/home/claims/form"
).split()
BLOCKED = (
    "www.hot-naked-girls.example/gallery/4412 free-sex-cams.example/live/room/22 xxx-tube-videos.example/watch/amateur adult-dating-tonight.example/join porn-hd-streaming.example/category/milf "
    "best-online-casino-bonus.example/free-spins www.poker-jackpot-slots.example/play/now bet-win-sports-odds.example/bonus/100 slot-machines-free.example/casino/register roulette-royal.example/deposit/bonus "
    "cheap-viagra-online.example/buy/no-prescription www.generic-cialis-pills.example/order discount-pharmacy-meds.example/buy/xanax tramadol-overnight.example/cheap/order weight-loss-miracle-pills.example/buy/now "
    "payday-loans-instant.example/apply/now bad-credit-cash-advance.example/loan/fast www.quick-money-loans.example/approval get-rich-crypto.example/invest/double bitcoin-doubler-profit.example/deposit "
    "replica-rolex-watches.example/cheap/sale fake-designer-handbags.example/outlet louis-vuitton-outlet-cheap.example/bags cheap-nike-shoes-outlet.example/sale wholesale-jerseys-china.example/cheap "
    "free-iphone-winner.example/claim/prize www.you-won-gift-card.example/claim/now congratulations-lucky-visitor.example/survey/reward secure-login-paypal-verify.example/account/confirm "
    "bank-account-update-alert.example/verify/password appleid-locked-support.example/login/unlock microsoft-virus-warning.example/call/now netflix-billing-problem.example/signin/update "
    "buy-instagram-followers.example/cheap/1000 seo-backlinks-cheap.example/buy/links link-exchange-directory.example/submit/free article-spinner-seo.example/keywords/traffic web-traffic-bot.example/buy/visitors "
    "cracked-software-keygen.example/download/full torrent-movies-free.example/download/hd serial-key-crack.example/office/activator warez-games-full.example/iso/download nulled-scripts-themes.example/free/download "
    "russian-brides-online.example/meet/girls escort-service-city.example/girls/vip sexy-singles-near-you.example/chat/now mature-hookup-site.example/signup/free webcam-strip-show.example/live/girls "
    "essay-writing-service-cheap.example/order/now buy-fake-diploma.example/degree/online fake-passport-id.example/buy hacked-accounts-store.example/buy/netflix carding-cvv-shop.example/dumps "
    "hoodia-diet-pills.example/order/cheap steroids-for-sale.example/buy/hgh male-enhancement-pills.example/bonus/order hgh-anabolic-shop.example/cheap penis-enlargement.example/buy/now "
    "forex-robot-profit.example/signals/free binary-options-winner.example/trade/bonus make-money-fast-home.example/join/now work-from-home-cash.example/earn/daily mlm-income-secret.example/signup "
    "spam-comments.example/out/redirect www.ad-clicks.example/go/offer popunder-ads.example/redirect/deal clickbait-offers.example/win/now doorway-pages.example/seo/keyword/331 "
    "hot-deals-coupon-cheap.example/buy/discount cheap-tickets-scam.example/claim/free lottery-winner-online.example/prize/claim free-gift-cards-generator.example/survey psychic-love-spells.example/order "
    "adult-toys-sex-shop.example/sale/xxx nude-celebs-leaked.example/photos/xxx hentai-porn-games.example/play/free lesbian-sex-videos.example/watch teen-cams-live.example/xxx/chat "
    "casino-affiliate-links.example/bonus/go sportsbook-betting-tips.example/odds/win blackjack-vip-casino.example/play/bonus bingo-free-bonus.example/register keno-lotto-win.example/jackpot/now"
).split()
#: Words of hosts for rows made by rule, so that neither a path nor an unknown name decides by itself.
SPAM_WORDS = (
    "cheap pills viagra casino bets betting poker slots jackpot adult xxx sex porn cams escort dating loans payday crypto doubler replica rolex "
    "free win winner prize spam clicks ads tracker popup warez crack torrent keygen followers backlinks seo traffic scam phish"
).split()
PLAIN_WORDS = (
    "garden river school museum library music travel science weather history kitchen bicycle market hospital theatre village forest harbour "
    "physics recipes journal teacher bridge railway church parliament photo chess farm island bakery castle painter league studio"
).split()
MADE = 150
BUCKETS, GRAMS = 1 << 14, (3, 4, 5)


def host_of(url: Column) -> Column:
    """The url's host, A-Z lower-cased; empty where there is none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of ``^host$`` and of the path."""
    rows, cells = [], []
    for salt, texts in ((1, [f"^{h}$" if h else "" for h in hosts]), (2, paths)):
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        for n in GRAMS:
            if len(data) < n:
                continue
            code = np.full(len(data) - n + 1, salt * 16 + n, np.uint64)
            for i in range(n):
                code = code * np.uint64(257) + data[i : len(data) - n + 1 + i]
            same = row[: len(code)] == row[n - 1 :]
            rows.append(row[: len(code)][same])
            cells.append((mix(code[same]) % np.uint64(BUCKETS)).astype(np.int64))
    empty = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(cells)) if rows else (empty, empty)


def _margins(weights: np.ndarray, bias: float, rows: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
    count = np.maximum(np.bincount(rows, minlength=n), 1)
    return np.bincount(rows, weights=weights[cells], minlength=n) / np.sqrt(count) + bias


def labelled() -> tuple[list[str], np.ndarray]:
    """The table above and the rows made by rule: invented or plain names are ordinary, names with a spam word are not."""
    rng = np.random.Generator(np.random.PCG64(41))
    pick = lambda words: words[rng.integers(len(words))]
    name = lambda: "".join(pick("bcdfghklmnprstvwz") + pick("aeiou") + pick(["", "n", "r", "s", "l"]) for _ in range(rng.integers(2, 5)))
    made: list[str] = []
    for block in (0, 1):
        for _ in range(MADE):
            words = [pick(PLAIN_WORDS) if rng.random() < 0.4 else name()]
            if block:
                words = [pick(SPAM_WORDS), pick([*SPAM_WORDS, *words])]
            rng.shuffle(words)
            lead, path = pick(["", "www.", "blog.", "m."]), pick(["/{}", "/{}/{}", "/en/{}", "/{}.html", "/de/{}/"])
            made.append(lead + pick(["-", ""]).join(words) + ".example" + path.format(rng.integers(1, 9999), name()))
    y = np.repeat([0.0, 1.0, 0.0, 1.0], [len(ALLOWED), len(BLOCKED), MADE, MADE])
    return [*ALLOWED, *BLOCKED, *made], y


def _parts(urls: list[str]) -> tuple[list[str], list[str]]:
    split = [u.partition("/") for u in urls]
    return [h for h, _, _ in split], [f"/{p}" for _, _, p in split]


def fit(hosts: list[str], paths: list[str], y: np.ndarray, steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by gradient descent."""
    rows, cells = features(hosts, paths)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-_margins(weights, bias, rows, cells, len(y)))) - y
        weights -= rate * (np.bincount(cells, weights=(miss * scale)[rows], minlength=BUCKETS) + decay * weights)
        bias -= rate * miss.mean()
    return weights, bias


@lru_cache(maxsize=1)
def train() -> tuple[np.ndarray, float]:
    """Weights and bias, fitted to the labelled table."""
    urls, y = labelled()
    return fit(*_parts(urls), y)


def held_out_accuracy(folds: int = 5) -> float:
    """Share of the written rows of the table that models of the other folds judge rightly."""
    urls, y = labelled()
    hosts, paths = _parts(urls)
    written, right = len(ALLOWED) + len(BLOCKED), 0
    for k in range(folds):
        own = [i for i in range(written) if i % folds == k]
        rest = [i for i in range(len(y)) if i >= written or i % folds != k]
        weights, bias = fit([hosts[i] for i in rest], [paths[i] for i in rest], y[rest])
        rows, cells = features([hosts[i] for i in own], [paths[i] for i in own])
        right += int(((_margins(weights, bias, rows, cells, len(own)) >= 0) == (y[own] > 0)).sum())
    return right / written


def _judge(weights: np.ndarray, bias: float, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows, cells = features(part.column("host").to_pylist(), part.column("path").to_pylist())
            score = 1 / (1 + np.exp(-_margins(weights, bias, rows, cells, part.num_rows)))
            block = pa.array(np.where(score >= threshold, "block", "allow"), pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), block], [*part.schema.names, "score", "guess"])

    return run


def _rule(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit("/" + rest))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages``."""
    weights, bias = train()
    parts = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    kind = dict(parts.dtypes)["page_id"]
    scored = parts.mapInArrow(_judge(weights, bias, threshold), f"page_id {kind}, host string, path string, score double, guess string")
    rule, verdict = _rule(rules, F.col("host"), F.col("path"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "guess").alias("verdict"), "score")


def op6_urls(spark, sf_dir: str) -> DataFrame:
    """Verdict of rules and model on the url of every page."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
