"""Constants of the engine, overridable through Settings, and the crawl configuration."""

from __future__ import annotations

import configparser
import re
from dataclasses import dataclass, field

# Results depend on them.
FIELD_WEIGHTS = {"title": 3.0, "headings": 2.0, "bold": 1.5, "body": 1.0}
TRAP_QUERY_KEYS = """
outlook-ical ical tribe-bar-date eventdisplay utm_source utm_medium utm_campaign utm_term utm_content share
replytocom redirect_to ajax format feed do idx rev tab ns search q s id page offset limit start sort order
filter view action
""".split()
TRAP_PATHS = """
/calendar /events/ /event/ /feed /rss /xml /json /wp-admin /wp-login /tag/ /category/ /author/ /print/ /pdf/
/export/ /download/ /search /query /results /action/ /special/ /recent /revisions /history
""".split()
STOP_WORDS = """
a about above after again against all am an and any are as at be because been before being below between both
but by can could did do does doing down during each few for from further had has have having he her here hers
herself him himself his how i if in into is it its itself me more most my myself no nor not of off on once only
or other our ours ourselves out over own same she should so some such than that the their theirs them themselves
then there these they this those through to too under until up very was we were what when where which while who
whom why with you your yours yourself yourselves
""".split()
DOMAIN_STOP_WORDS = """
ics uci edu wiki php doku https http login password account email access support please ssh key credentials
authentication restricted obtaining privileges logged remember cookies affiliates insufficient enabled enter
currently make sure helpdesk hardware software services group log page pages section file files user users html
pdf kb trac download index automatic
""".split()
BLOCKED_EXTENSIONS = """
css js bmp gif jpg jpeg ico png tif tiff mid mp2 mp3 mp4 wav avi mov mpeg ram m4v mkv ogg ogv pdf ps eps tex ppt
pptx doc docx xls xlsx names data dat exe bz2 tar msi bin 7z psd dmg iso epub dll cnf tgz sha1 thmx mso arff rtf
jar csv rm smil wmv swf wma zip rar gz apk ipa deb rpm img toast vcd txt ppsx pps potx pot pptm potm ppam ppsm
""".split()
BLOCKED_ACTIONS = ["search", "recent", "index", "revisions", "backlink"]


@dataclass(frozen=True)
class Settings:
    weights: dict = field(default_factory=lambda: dict(FIELD_WEIGHTS))
    anchor_weight: float = 2.0
    alpha: float = 0.85
    iterations: int = 20
    coverage: float = 0.05
    bigram_bonus: float = 0.5
    phrase_bonus: float = 1.0
    rank_weight: float = 0.2
    top_k: int = 15
    hamming: int = 3
    bucket_bits: int = 12
    max_params: int = 6
    max_query: int = 120
    max_variants: int = 20
    min_words: int = 50
    host_suffix: str = ".uci.edu"


@dataclass(frozen=True)
class CrawlConfig:
    """Crawl settings of an INI file: user agent (checked), threads, seeds (comma separated), politeness, save file."""

    user_agent: str
    threads: int
    seeds: list[str]
    politeness: float
    save_file: str

    @classmethod
    def read(cls, path: str) -> CrawlConfig:
        ini = configparser.ConfigParser()
        with open(path) as f:
            ini.read_file(f)
        agent = ini["IDENTIFICATION"]["USERAGENT"].strip()
        if agent == "DEFAULT AGENT" or not re.fullmatch(r"[a-zA-Z0-9_ ,]+", agent):
            raise ValueError("set a USERAGENT of letters, digits, underscores, commas and blanks")
        crawl = ini["CRAWLER"]
        seeds = [x.strip() for x in crawl["SEEDURL"].split(",") if x.strip()]
        return cls(agent, ini.getint("LOCAL PROPERTIES", "THREADCOUNT"), seeds, crawl.getfloat("POLITENESS"), ini["LOCAL PROPERTIES"]["SAVE"])
