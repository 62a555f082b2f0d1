"""URL filter: host and path rules first, then a weighted vocabulary.

An Aho-Corasick automaton finds all terms of the vocabulary in the ASCII
lower-cased URL in one pass.  A hit counts only where it is not part of a
longer run of ASCII letters and digits.  One strict term blocks, and so do
``soft_limit`` distinct soft terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, release, ship

# Fixed values: (host, path, verdict); a rule fits its host, all subdomains, and paths with its prefix.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

# The vocabulary by subject: words of the four languages of the corpus, strict ones first.  A strict word names such
# pages by itself; a soft one has other meanings too.
_ADULT = (
    "porn porno porns pornhd xxx sexcam sexcams camgirl camgirls camsex hentai milf milfs gangbang bukkake blowjob deepthroat creampie pornostar pornstar pornstars pornografie pornographie pornografia "
    "sexvideo sexvideos sexfilme sexkontakte fickfilme nacktbilder hurenkartei putas follando sexo-gratis videos-x plan-cul filles-nues sexe-gratuit",
    "adult adults amateur babes bdsm boobs busty camera-girls dating desnudas desnudo erotic erotica erotik erotique escort escorts fetish fetisch flirt fkk girls gratis-sex hookup hot-girls "
    "latex lingerie nackt naked nude nudes nudist nues nus orgy sex sexe sexo sexy singles strip striptease swinger swingers upskirt voyeur webcam webcams",
)
_GAMBLING = (
    "onlinecasino online-casino casino-bonus casinobonus freespins free-spins slotmachine slot-machines sportwetten wettbonus casino-en-ligne apuestas-online tragaperras pokerbonus",
    "apuesta apuestas bet bets betting bingo blackjack bonus bookie bookmaker casino casinos gambling gewinnspiel glucksspiel jackpot jeux lotteria lottery lotterie loterie loteria lotto paris poker pokies roulette "
    "ruleta slot slots spielautomat spielautomaten wager wetten wette",
)
_PHARMACY = (
    "viagra-online buy-viagra buyviagra buy-cialis cheap-viagra generic-viagra levitra-online kamagra potenzmittel rezeptfrei tramadol-online xanax-online no-prescription sans-ordonnance sin-receta",
    "anabolic apotheke cialis diet dianabol farmacia kamagra-oral levitra medikamente medication pharma pharmacie pharmacy phentermine pillen pills pilules pastillas prescription steroide steroids tramadol valium viagra "
    "weightloss weight-loss xanax",
)
_PIRACY = (
    "warez keygen keygens crackz serialz cracked-software nulled-scripts torrent-download full-crack telecharger-gratuit-crack descargar-crack iptv-gratis iptv-free",
    "activator apk crack cracked cracks descargar download-free emule filesharing free-download gratis gratuit hack hacks iptv kostenlos leaked mega-link modded nulled patch peliculas rapidshare serial serials "
    "streaming telecharger torrent torrents unlocked",
)
_FRAUD = (
    "phishing malware spam-farm link-farm linkfarm get-rich-quick getrichquick make-money-fast carding fullz ponzi fake-id fakeids replica-watches replicawatches schnell-geld-verdienen argent-facile dinero-facil",
    "backlinks binary-options bitcoin-doubler cash cheap credit credito darlehen dinero essay-service fake faux forex gagner-argent geld geldverdienen guaranteed imitation kredit loan loans money payday prestamo prestamos pret "
    "prets replica replicas seo-links spam spin-bot sofortkredit traffic-bot verdienen",
)


def _words(*lists: str) -> tuple[str, ...]:
    return tuple(sorted({w for words in lists for w in words.split()}))


STRICT = _words(*(strict for strict, _ in (_ADULT, _GAMBLING, _PHARMACY, _PIRACY, _FRAUD)))
SOFT = tuple(w for w in _words(*(soft for _, soft in (_ADULT, _GAMBLING, _PHARMACY, _PIRACY, _FRAUD))) if w not in STRICT)
SOFT_LIMIT = 2

_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (ASCII lower-cased) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_LOWER), slash + path


class RuleIndex:
    """Rules by host; the longest host wins, then the longest path."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self._by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self._by_host.setdefault(host, []).append((path, verdict))
        for paths in self._by_host.values():
            paths.sort(key=lambda p: -len(p[0]))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        at = 0
        while True:
            for prefix, verdict in self._by_host.get(host[at:], ()):
                if path.startswith(prefix):
                    return host[at:] + prefix, verdict
            dot = host.find(".", at)
            if dot < 0:
                return None
            at = dot + 1


class Vocabulary:
    """All terms in one automaton, strict ones with weight 2 and soft ones with weight 1; a term in both lists is strict."""

    def __init__(self, strict: Iterable[str], soft: Iterable[str]):
        self._automaton = ahocorasick.Automaton()
        for weight, terms in ((1, soft), (2, strict)):
            for t in terms:
                self._automaton.add_word(t, (weight, t))
        self._filled = len(self._automaton) > 0
        if self._filled:
            self._automaton.make_automaton()

    def hits(self, url: str) -> tuple[set[str], set[str]]:
        """Distinct strict and soft terms in ``url`` that stand alone."""
        found: tuple[set[str], set[str]] = (set(), set())
        if not self._filled:
            return found
        text = url.translate(_LOWER)
        for end, (weight, term) in self._automaton.iter(text):
            start = end + 1 - len(term)
            if (start == 0 or text[start - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                found[2 - weight].add(term)
        return found


def filter_urls(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", rules: Iterable[tuple[str, str, str]] = RULES, strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """``id, host, path, rule, verdict, n_strict, n_soft`` for every row of ``pages``.

    ``strict`` and ``soft`` replace the vocabulary, with lower-case terms of any table
    that fits a broadcast (an error beyond 64 MB).

    A null URL, or one without ``://``, has an empty host and path, fits no
    rule, and is judged by the vocabulary (null: allowed).  Repeated rows are
    judged alike; an empty table gives an empty result; other columns are not
    read.
    """
    rules, strict, soft = tuple(rules), tuple(strict), tuple(soft)
    shipped = ship(pages.sparkSession, (rules, strict, soft), sum(len(x.encode()) for x in (*strict, *soft, *(y for r in rules for y in r))))
    id_type = pages.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rules, strict, soft = shipped.value
        index, vocabulary = RuleIndex(rules), Vocabulary(strict, soft)
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = index.find(host, path)
                s, t = vocabulary.hits(url or "")
                verdict = rule[1] if rule else "block" if s or len(t) >= soft_limit else "allow"
                rows.append((host, path, rule[0] if rule else None, verdict, len(s), len(t)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.string()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    out = on_workers(pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"))).mapInArrow(run, f"id {id_type}, host string, path string, rule string, verdict string, n_strict long, n_soft long")
    return out.withColumnRenamed("id", id_column)


def oracle() -> str:
    """DuckDB SQL for the rows of ``filter_urls`` over ``pages``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: (-len(r[0]), -len(r[1])))
    # the terms that stand alone between what is no letter or digit, each counted once
    count = lambda terms: f"len(list_filter([{', '.join(repr(t) for t in terms)}], lambda t: contains(low, t) AND regexp_matches(low, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')))"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in ordered)
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{upper}', '{lower}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, translate(coalesce(url, ''), '{upper}', '{lower}') AS low
  FROM pages),
ruled AS (
  SELECT page_id, host, path, CASE {rule} END AS rule, CAST({count(STRICT)} AS BIGINT) AS n_strict, CAST({count(SOFT)} AS BIGINT) AS n_soft FROM parts)
SELECT page_id, host, path, rule, CASE {verdict} WHEN n_strict > 0 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft
FROM ruled"""
