"""A small labelled URL table, written by hand: what hosts and paths are about, not where they are.

Each name is paired with paths of its own kind and with paths that either kind has, under prefixes
and suffixes that both kinds share in turn, so that neither tells the kind.
"""

from __future__ import annotations

import pyarrow as pa

#: Fixed values.
UNWANTED = """
casino-royal online-casino free-casino best-bets bets-today sportsbet-live poker-room slot-spins jackpot-winner lottery-prize
cheap-pills pills-online pharmacy-discount viagra-store weight-loss-miracle replica-watches fake-bags payday-loan quick-cash
get-rich-now crypto-giveaway spam-mailer spamlinks link-farm seo-links click-farm ads-server ad-network adtrack popup-ads
banner-ads track-click malware-load phish-login free-download warez-crack keygen-serial adult-cams adult-video xxx-movies
hot-singles sex-chat win-prizes free-money free-bonus cheap-meds cheap-tickets-scam buy-followers
""".split()
ORDINARY = """
city-library daily-news open-science garden-notes home-recipes travel-journal school-district university-press health-advice
art-museum weather-report local-history book-review music-lessons code-docs math-forum bird-watching train-timetable
town-council rowing-club film-archive language-course chess-club parents-guide photo-blog energy-research law-reports
village-bakery bike-repair church-choir animal-rescue theatre-tickets mountain-huts river-survey old-maps star-charts
wood-work plant-shop radio-hour letters-page press-office standards-body job-board student-union fire-service water-board
harbour-master field-notes stone-age deep-sea kitchen-table winter-tales paper-mill north-road green-valley silver-lake
station-street long-walks small-engines evening-post sunday-paper morning-star harvest-home meadow-view thimble thornton
hathaway terrington hendon theron brambles tansley winterton ashford melton linden
""".split()
UNWANTED_PATHS = ("/bonus/claim", "/buy/cheap-now", "/win/prize", "/free/download.exe", "/click/offer", "/xxx/video")
ORDINARY_PATHS = ("/about/us", "/docs/intro", "/news/article", "/history/chapter", "/contact", "/events/calendar")
SHARED_PATHS = ("/", "/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/{}/index.html")
PREFIXES = ("", "www.", "m.", "blog.", "shop.")
SUFFIXES = ("com", "org", "net", "info", "example.com", "example.org", "example.net")


def labelled_urls() -> pa.Table:
    """host, path, block (1: unwanted)."""
    rows = []
    for block, names, own in ((1, UNWANTED, UNWANTED_PATHS), (0, ORDINARY, ORDINARY_PATHS)):
        for k, name in enumerate(names):
            for j in range(4):
                at = 4 * k + j
                path = own[at % len(own)] if j == 0 else SHARED_PATHS[at % len(SHARED_PATHS)].format(17 * at + 3)
                rows.append((f"{PREFIXES[at % len(PREFIXES)]}{name}.{SUFFIXES[at % len(SUFFIXES)]}", path, block))
    hosts, paths, blocks = zip(*rows)
    return pa.table({"host": pa.array(hosts), "path": pa.array(paths), "block": pa.array(blocks, pa.int32())})
