"""Fixed values that results depend on. Every operator takes its lexicon as an argument; these are the defaults.

Lexicons of religious, ethnic and other personal identities are data of the user's (see `load`); only a small sample of historical merchant
communities is kept here for tests.
"""

from __future__ import annotations

import json
from pathlib import Path

# Four-digit years.
YEAR = r"\b(1[6-9]\d{2}|20[0-2]\d)\b"

# Prefixes of law codes such as BA1933.
LAW_PREFIXES = {
    "BA": "Bankruptcy Act",
    "TA": "Treasury Tax Act",
    "SA": "Securities Act",
    "FA": "Federal Reserve Act",
    "IA": "Interstate Commerce Act",
    "AA": "Antitrust Act",
    "PA": "Public Utility Holding Company Act",
    "DA": "Deposit Insurance Act",
    "CA": "Clean Air/Climate Act",
    "BHCA": "Bank Holding Company Act",
    "EA": "Energy Act",
    "LA": "Public mineral and land law",
}

# Acronyms and what they stand for.
ACRONYMS = {
    "BANK": "World Bank", "BOE": "Bank of England", "ECSC": "European Coal & Steel Community", "DOJ": "Department of Justice", "FRS": "Federal Reserve System",
    "FRBNY": "Federal Reserve Bank of New York", "FPC": "Federal Power Commission", "FTC": "Federal Trade Commission", "ICC": "Interstate Commerce Commission",
    "RFC": "Reconstruction Finance Corporation", "SEC": "Securities and Exchange Commission", "TRC": "Texas Railroad Commission", "UST": "United States Treasury",
    "WFC": "War Finance Corporation", "LABOR": "United Mine Workers", "NYSE": "New York Stock & Bond Exchange", "NYCH": "New York Bank Clearinghouse Association",
    "EAC": "English Royal Africa Company", "EIC": "English East India Company", "COALA": "Philadelphia Reading Railroad & Coal", "COALB": "Consolidation Coal Company",
    "MMFR": "Federal Reserve funds money market", "MMUST": "US Treasury bond money market", "MMEU": "Eurodollar money market", "MMEA": "USD Asia money market",
    "MMSEC": "NYSE collateral loan money market", "MMF": "Money market mutual fund", "SBs": "State-regulated banks", "NBs": "National banks", "LICs": "Life insurance companies",
    "CP": "Commercial paper", "CDs": "Certificates of deposit", "ABCP": "Asset-backed commercial paper", "HYB": "High-yield bonds", "LBOs": "Leveraged buyouts",
    "VC": "Venture capital", "ESOPs": "Employee stock ownership plans", "MMBU": "Foreign trade bills payable in London", "USLTN": "US legal tender notes",
    "PU": "Public utility companies", "HC": "Holding companies", "RHC": "Railroad holding companies", "PUHC": "Public utility holding companies",
    "RIHC": "Railroad investment holding companies", "PUIHC": "Public utility investment holding companies", "BHC": "Bank holding companies", "IHC": "Investment holding companies",
    "DEI": "Diversity, Equity, and Inclusion",
}

# Words that are no search terms.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were tell me about what who when where how why it he she we they this that these those"
    " be been being have has had do does did will would could should may might must can"
).split()

# Last words of proper names that are no surnames, and single words that are no firms.
GENERIC_NAME_WORDS = (
    "bank banks trust trusts company companies co corp corporation inc incorporated ltd limited group holding holdings partners partnership associates brothers sons son"
    " york london paris berlin vienna amsterdam brussels geneva america american british french german swiss italian national international federal state central commercial"
    " investment merchant private public royal imperial exchange credit finance capital securities assets"
).split()

# Places that may follow an acronym.
PLACES = (
    "new york,boston,chicago,philadelphia,cleveland,richmond,atlanta,st louis,minneapolis,kansas city,dallas,san francisco,london,paris,vienna,berlin,amsterdam,brussels,zurich,"
    "geneva,frankfurt,milan,madrid,lisbon,stockholm,copenhagen,tokyo,hong kong,singapore,shanghai,beijing,mumbai,dubai"
).split(",")

# Subjects too general to select by.
GENERIC_SUBJECTS = (
    "bank banking banks finance financial financing market markets money capital credit credits trade trading commerce commercial system systems policy policies role roles history"
    " impact influence network networks family families banker bankers activities operations stories story overview analysis sector sectors industry industries power control panic"
    " panics crisis crises economy economic united states securities exchange commission board act acts rule rules regulation regulations section sections agency agencies"
).split()

# Regions by pattern, the first that matches wins.
REGIONS = [
    ("United States", r"\b(america|united states|u\.s\.|new york|chicago|boston|wall street|federal reserve|mcadoo|wilson)\b"),
    ("Britain", r"\b(britain|british|england|london|bank of england|sterling|pound)\b"),
    ("Germany", r"\b(germany|german|berlin|hamburg|frankfurt|reichsbank|mark)\b"),
    ("France", r"\b(france|french|paris|banque de france|franc)\b"),
    ("Russia", r"\b(russia|russian|moscow|saint-petersburg|ruble)\b"),
    ("Austria-Hungary", r"\b(austria|austrian|habsburg|vienna)\b"),
    ("Ottoman Empire", r"\b(ottoman|turkey|turkish|constantinople)\b"),
    ("Asia", r"\b(india|china|japan|asia|bombay|calcutta|shanghai|tokyo)\b"),
]
OTHER_REGION = "Other/Global"

# Periods by pattern, the last that matches wins.
PERIODS = [
    ("Medieval", r"\b(1[0-4]\d{2}|[89]\d{2})\b"),
    ("16th-17th centuries", r"\b(15\d{2}|16\d{2}|17\d{2})\b"),
    ("18th century", r"\b(17[0-9]\d)\b"),
    ("19th century", r"\b(18\d{2})\b"),
    ("20th century", r"\b(19\d{2})\b"),
    ("21st century", r"\b(20[012]\d)\b"),
]
UNDATED = "Undated"

# Words that make a question one about events, control, markets, ideology.
EVENT_WORDS = "panic crisis crash collapse war revolution depression recession bubble run default".split()
CONTROL_WORDS = "control controls controlled controlling dominate dominates dominated dominating influence influences influenced influencing power powers".split()
MARKET_WORDS = (
    "money market,money-market,capital market,bond market,commercial paper,commercial-paper,abcp,mmeu,mmea,eurodollar,euro-dollar,euro dollar,eurodollar market,euro-market,euro market,"
    "libor,eurobond,railroad securities,reit,real estate trust,real-estate trust,conglomerate stock,technology stock,tech stock,slave market,diversity finance,dei investments,"
    "long-term capital,asset-backed,asset backed,junk bond,high-yield,high yield,venture capital,lbo,leveraged buyout,money fund,money-fund,money market mutual fund,"
    "trade bills,bills payable,foreign trade bills,legal tender notes,legal-tender notes,bank holding company act,holding company,market mutual fund"
).split(",")
IDEOLOGY_WORDS = "marxism marxist socialism socialist communism communist collectivism collectivist".split()
IDEOLOGY_FINANCE = "bank,banking,credit,money,market,securities,bond,equity,stock,capital,liquidity,exchange,regulation,balance sheet,benchmark,margin".split(",")
IDEOLOGY_TRANSITION = (
    "nationalize,nationalised,nationalized,collectivize,collectivised,collectivized,expropriate,expropriation,confiscate,decree,five-year plan,plan economy,"
    "state bank,central plan,command economy,price control,currency reform"
).split(",")
IDEOLOGY_CRISIS = "panic panics crisis crises 1763 1825 1873 1893 1907 1929 1973 1974 1987 1998 2008".split()
# Words that show that a text is about finance, words that speak of a crisis, and other names of the same body.
FINANCE_WORDS = (
    "bank banking banker bankers finance financial financier financiers investment investor investors capital credit loan lending firm company corporation enterprise insurance lic mesbic"
    " cdfi supplier contract wealth business businesses stock stocks bond bonds securities exchange market markets"
).split()
CRISIS_TERMS = "panic crisis crises 1973 1974 1987 1998 2008 1929 1907 1825 1873".split()
ALIASES = {
    "narodny bank": ["narodny"],
    "vneshtorgbank": ["vneshtorg", "bank for foreign trade", "vneshtorg bank"],
    "vneshtorg": ["vneshtorgbank", "bank for foreign trade"],
    "frs": ["federal reserve system", "federal reserve"],
    "boe": ["bank of england"],
}

# Contexts in which a text on finance is not about an identity, and words that count in lower case only in such contexts.
FINANCE_EXCLUDED = [r"\bblack sea\b", r"\bblack sea fleet\b", r"\beugene black\b", r"\bblack tea\b"]
CAPITALISED = {
    "black": (
        "black-owned,black banker,black bank,black community,black person,black individual,black elite,black family,black american,black african,black slave,black loyalist,"
        "black lic,black frs,black governor,black chair"
    ).split(",")
}

# What makes a name the subject of a text that lists it.
SUBJECT_VERBS = "was were is are became founded established merged acquired".split()
SUBJECT_NOUNS = "family families bank banking firm company".split()

# What is added to a short answer, and the questions that follow one.
CONTEXT_NOTE = "\n\n**Additional Context:**\n- Clarify scope across decades present in sources.\n- Highlight leadership where mentioned (chairs, directors).\n"
RELATED = "What role did {} play in this topic, according to the documents?"
RELATED_FILLERS = [
    "Which panics or crises affected this subject and how did access to finance change?",
    "How did identity groups (e.g., Jews, Dalits, women) gain or lose access to banking here?",
    "Which nationalizations or decrees changed bank control, and with what outcomes?",
]

# Crises that a full answer mentions.
CRISIS_WORDS = ["panic of", "panic", "crisis", "crash", "depression", "recession", "bubble", "run"]
CRISIS_YEARS = (
    "1763 1772 1792 1819 1825 1837 1847 1857 1866 1873 1884 1890 1893 1896 1901 1907 1910 1914 1920 1929 1931 1973 1987 1997 1998 2001 2007 2008 2009"
).split()

# Patterns of changed names, the old name in the first group and the new one in the second.
NAME_CHANGES = [r"([A-Z][a-z]+)\s+(?:changed|anglicized).*?name.*?to\s+([A-Z][a-z]+)", r"([A-Z][a-z]+).*?formerly.*?([A-Z][a-z]+)"]

# A sample for tests: canonical term, variants; parent, children.
SAMPLE_GROUPS = {
    "quaker": ["quaker", "quakers"],
    "huguenot": ["huguenot", "huguenots"],
    "mennonite": ["mennonite", "mennonites"],
    "parsi": ["parsi", "parsis", "parsee", "parsees"],
    "court bankers": ["court banker", "court bankers"],
}
SAMPLE_HIERARCHY = {"merchant community": ["quaker", "huguenot", "mennonite", "parsi"], "protestant": ["quaker", "huguenot", "mennonite"]}


def load(path: str | Path) -> dict:
    """A lexicon of the user's: a JSON object of lists or strings; an empty one where the file is missing."""
    path = Path(path)
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
