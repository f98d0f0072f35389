"""Dimensions of the text model: event rules, filing items, lexicon, tokens.

A ``TextDims`` value is passed to every text operator, so a caller can bring another language or
corpus. ``FINANCE`` holds the finance values; ``riskloom.corpus`` holds those of the test prose.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: event classes, in tie-break order ------------------------------------------
PRIORITY = (
    "CREDIT_EVENT", "GEOPOLITICAL", "MACROECONOMIC", "LEGAL_REGULATORY", "OPERATIONAL_ESG",
    "EARNINGS_GUIDANCE", "MA_CORPORATE_ACTION", "PRODUCT_STRATEGY", "MANAGEMENT_GOVERNANCE", "OTHER",
)

# ---- fixed values: filing item -> (class, subtype, severity rank) -----------------------------
FILING_ITEMS = (
    ("1.03", "CREDIT_EVENT", "BANKRUPTCY", 10),
    ("2.04", "CREDIT_EVENT", "ACCELERATION_TRIGGER", 9),
    ("1.05", "OPERATIONAL_ESG", "CYBER_INCIDENT", 8),
    ("4.02", "LEGAL_REGULATORY", "RESTATEMENT", 8),
    ("3.01", "LEGAL_REGULATORY", "DELISTING_NOTICE", 7),
    ("5.01", "MA_CORPORATE_ACTION", "CHANGE_IN_CONTROL", 7),
    ("2.06", "EARNINGS_GUIDANCE", "IMPAIRMENT", 6),
    ("2.01", "MA_CORPORATE_ACTION", "ACQUISITION_COMPLETED", 6),
    ("2.02", "EARNINGS_GUIDANCE", "RESULTS", 6),
    ("1.01", "MA_CORPORATE_ACTION", "MATERIAL_AGREEMENT", 5),
    ("1.02", "MA_CORPORATE_ACTION", "AGREEMENT_TERMINATED", 5),
    ("2.05", "OPERATIONAL_ESG", "RESTRUCTURING", 5),
    ("5.02", "MANAGEMENT_GOVERNANCE", "OFFICER_CHANGE", 5),
    ("4.01", "MANAGEMENT_GOVERNANCE", "AUDITOR_CHANGE", 5),
    ("2.03", "MA_CORPORATE_ACTION", "DEBT_ISSUANCE", 3),
)

# ---- fixed values: (class, subtype, weight, case-insensitive pattern) -------------------------
RULES = (
    ("CREDIT_EVENT", "BANKRUPTCY", 3.0, r"\bbankrupt\w*|\bchapter 11\b|\breceivership\b|\binsolven\w*"),
    ("CREDIT_EVENT", "DEFAULT", 3.0, r"\bdefault(?:ed|s)? on\b|\bmissed (?:a |an |its )?(?:coupon|interest|debt) payment"),
    ("CREDIT_EVENT", "DOWNGRADE", 2.5, r"\b(?:credit )?rating (?:cut|downgrade)\b|\bdowngrade[sd]? (?:its |the )?(?:credit|debt|rating)\b|\bcut to junk\b|\bjunk status\b"),
    ("CREDIT_EVENT", "BANK_RUN", 3.0, r"\bbank run\b|\bdeposit (?:flight|outflows?|withdrawals?)\b|\b(?:pull|pulls|pulled|pulling|withdraw|withdrawing|withdrew|move|moving) (?:their |our |its )?(?:deposits|cash|money|funds)\b|\blimit(?:s|ing|ed)? withdrawals\b|\bhalt(?:s|ing|ed)? (?:customer )?withdrawals\b|\bwithdrawal limits?\b|\bbank (?:collapse|failure)s?\b|\bcollapses?\b.{0,40}\bbank\b|\bclosed by (?:\w+ )?regulators?\b|\bFDIC\b|\bbanks?\b.{0,40}\b(?:panic|crisis|meltdown|collapse)\b|\b(?:panic|crisis|meltdown)\b.{0,40}\bbanks?\b|\b(?:shuts?|closes|seize[sd]?|takes? (?:control|over))\b.{0,30}\bbank\b"),
    ("CREDIT_EVENT", "LIQUIDITY_STRESS", 2.0, r"\bliquidity (?:crisis|crunch|squeeze|fears?|concerns?)\b|\bcovenant breach\b|\bdebt restructuring\b|\bshor(?:e|es|ing) up (?:its )?(?:balance sheet|capital|finances)\b|\bemergency (?:capital|funding|lending|backstop)\b|\bcapital raise\b|\bbank failures?\b|\bcontagion\b"),
    ("GEOPOLITICAL", "TRADE_WAR", 2.5, r"\btariffs?\b|\btrade war\b|\bimport dut(?:y|ies)\b|\bretaliatory\b"),
    ("GEOPOLITICAL", "SANCTIONS", 2.5, r"\bsanctions?\b|\bembargo\b|\bexport controls?\b"),
    ("GEOPOLITICAL", "ARMED_CONFLICT", 3.0, r"(?<!trade )\bwar\b|\binvasion\b|\binvade[sd]?\b|\bmissiles?\b|\bairstrikes?\b|\bmilitary strikes?\b|\bceasefire\b"),
    ("GEOPOLITICAL", "POLITICAL_INSTABILITY", 2.0, r"\bcoup\b|\bterror(?:ist|ism)?\b|\bunrest\b|\bsnap election\b"),
    ("MACROECONOMIC", "MONETARY_POLICY", 2.5, r"\binterest rates?\b|\brate (?:hike|cut|decision)s?\b|\brepo rate\b|\bbasis points?\b|\bFOMC\b|\bFederal Reserve\b|\bcentral bank\b|\bmonetary policy\b"),
    ("MACROECONOMIC", "INFLATION", 2.0, r"\binflation\b|\bCPI\b|\bconsumer prices\b"),
    ("MACROECONOMIC", "GROWTH_JOBS", 2.0, r"\bGDP\b|\brecession\b|\bjobs report\b|\bpayrolls\b|\bunemployment\b"),
    ("MACROECONOMIC", "RATES_MARKET", 1.5, r"\btreasury yields?\b|\bbond yields?\b|\b10-year yield\b"),
    ("MACROECONOMIC", "PANDEMIC", 2.5, r"\bpandemic\b|\boutbreak\b|\blockdowns?\b|\bcoronavirus\b|\bCOVID(?:-19)?\b"),
    ("MACROECONOMIC", "COMMODITIES", 2.0, r"\boutput cuts?\b|\boil prices?\b|\bcrude\b|\bOPEC\b"),
    ("MA_CORPORATE_ACTION", "MERGER_ACQUISITION", 2.5, r"\bacquir(?:e|es|ed|ing)\b|\bacquisition\b|\bmerger\b|\btakeover\b|\bbuyout\b|\bdeal to buy\b"),
    ("MA_CORPORATE_ACTION", "DIVESTITURE", 2.0, r"\bdivest\w*|\bspin[- ]?off\b|\bsell (?:a |its |the )?stake\b|\bsell (?:its|the) \w+ (?:unit|division|business)\b"),
    ("MA_CORPORATE_ACTION", "CAPITAL_RETURN", 2.0, r"\bbuybacks?\b|\bshare repurchase\b|\bdividend\b"),
    ("MA_CORPORATE_ACTION", "IPO", 2.0, r"\bIPO\b|\binitial public offering\b"),
    ("EARNINGS_GUIDANCE", "RESULTS", 2.0, r"\bearnings\b|\bquarterly (?:results|profit|revenue)\b|\bprofit estimates\b|\bEPS\b|\bbeats? (?:estimates|expectations)\b|\bmiss(?:es|ed)? (?:estimates|expectations)\b"),
    ("EARNINGS_GUIDANCE", "GUIDANCE", 2.5, r"\bguidance\b|\boutlook\b|\bforecast\b"),
    ("EARNINGS_GUIDANCE", "ANALYST_ACTION", 1.5, r"\bprice targets?\b|\banalysts? (?:upgrade|downgrade)s?\b|\b(?:upgrade|downgrade)[sd]? to (?:buy|sell|hold|neutral|overweight|underweight)\b"),
    ("PRODUCT_STRATEGY", "COMPETITIVE_THREAT", 2.0, r"\brivals?\b|\bcompetitors?\b|\bcheaper\b|\bdisrupt\w*"),
    ("PRODUCT_STRATEGY", "LAUNCH", 2.0, r"\blaunch(?:es|ed)?\b|\bunveil(?:s|ed)?\b|\breleases? (?:a |its )?(?:new|cheaper)\b|\bnew (?:model|product|lineup|chip)\b"),
    ("PRODUCT_STRATEGY", "RECALL", 2.5, r"\brecalls?\b|\brecalled\b"),
    ("PRODUCT_STRATEGY", "PARTNERSHIP", 1.5, r"\bpartnership\b|\bpartners with\b|\bteams up\b"),
    ("LEGAL_REGULATORY", "LITIGATION", 2.0, r"\blawsuit\b|\bsued\b|\bsues\b|\bcourt\b|\bjudge\b|\bsettlement\b"),
    ("LEGAL_REGULATORY", "ENFORCEMENT", 2.5, r"\bantitrust\b|\bprobe\b|\binvestigation\b|\bfined\b|\bfines? of\b|\bpenalt(?:y|ies)\b|\bregulators?\b"),
    ("LEGAL_REGULATORY", "APPROVAL", 2.0, r"\bFDA\b|\bapproval\b|\bapproved\b|\bclearance\b"),
    ("OPERATIONAL_ESG", "CYBER_INCIDENT", 3.0, r"\bcyber ?attack\b|\bhack(?:ed|ers)?\b|\bdata breach\b|\bransomware\b"),
    ("OPERATIONAL_ESG", "OUTAGE_ACCIDENT", 2.5, r"\boutage\b|\bexplosion\b|\bfire at\b|\baccident\b|\bplane crash\b|\bgrounded\b|\bgrounding\b"),
    ("OPERATIONAL_ESG", "LABOR", 2.0, r"\bstrike\b|\bwalkout\b|\blayoffs?\b|\bjob cuts\b"),
    ("OPERATIONAL_ESG", "ENVIRONMENTAL", 2.0, r"\boil spill\b|\bemissions\b|\bpollution\b"),
    ("MANAGEMENT_GOVERNANCE", "EXECUTIVE_CHANGE", 2.5, r"\b(?:CEO|CFO|chief executive|chairman)\b.{0,40}\b(?:steps? down|resign\w*|ousted|replaced|retire\w*|appointed|named)\b|\b(?:steps? down|resign\w*|appoint\w*|names?|named)\b.{0,40}\b(?:CEO|CFO|chief executive)\b"),
    ("MANAGEMENT_GOVERNANCE", "ACCOUNTING", 2.5, r"\baccounting (?:irregularit\w*|probe|issues?)\b|\bauditor\b|\brestate\w*"),
    ("MANAGEMENT_GOVERNANCE", "FRAUD_ALLEGATION", 3.0, r"\b(?:accounting |corporate )?fraud\b|\bfraudulent\b|\bstock manipulation\b|\bmanipulat(?:e|es|ed|ing|ion)\b.{0,30}\b(?:shares?|stocks?|prices?)\b|\bshort[- ]sell(?:er|ers|ing)?\b.{0,60}\b(?:report|allegations?|claims?|attack)\b|\b(?:largest|biggest) con\b|\bshell compan(?:y|ies)\b|\boffshore (?:shell|entities|funds)\b"),
)

# ---- fixed values: finance sentiment lexicon --------------------------------------------------
POSITIVE_WORDS = """
beat beats record surge surges surged soar soars soared rally rallies rallied upgrade upgraded upgrades growth gain
gains gained rise rises rose rising jump jumps jumped strong stronger robust raises raised raise lifts lifted boost
boosts boosted approval approved approves wins won win outperform outperforms upbeat optimistic recovers recovered
recovery rebound rebounds stable steady exceeds exceeded tops topped expands expansion bullish overweight higher
buyback success successful resilient normally
soaring ripping best recover protected backstop inflows rebounded reassures reassured accelerates accelerating
record-high eases eased easing pause relief climb climbs climbed climbing
"""
NEGATIVE_WORDS = """
miss misses missed fall falls fell falling drop drops dropped decline declines declined slump slumps plunge plunges
plunged tumble tumbles tumbled sink sinks sank slide slides slid slip slips slipped crash crashes selloff sell-off
losses loss lose loses lost weak weaker weakness cut cuts lowered lowers downgrade downgraded downgrades warning warns
warned fear fears concern concerns worries worry panic panicking probe investigation lawsuit sued fined fines penalty
recall recalls recalled outage breach hack hacked bankruptcy bankrupt default defaults defaulted layoffs halt halts
halted halting limiting grounding grounded delay delays delayed shortage sanctions tariff tariffs war invasion missile
missiles bearish sell underweight lower worst hit hits hammered spooking spooks spooked dip volatile turmoil rumors
rumours
doubts doubt worried nervous uncertain pressure rattles rattled hurt hurts dilution retaliates retaliatory escalates
escalated escalating recession slowdown slows slower sliding drags dragging fallout outflows ugly losing rattle threat
threatens risk risks spook scramble fled flee flight suspended suspends downturn shock slashes slashed
"""
STRONG_NEGATIVE_WORDS = """
crisis collapse collapses collapsed crash crashes plunge plunges plunged bankrupt bankruptcy insolvent insolvency
default defaulted fraud failure failed fails panic rout turmoil contagion receivership halt halts halted halting
bloodbath brutal crushed wiped tumble tumbles tumbled worst selloff sell-off run
"""
STRONG_POSITIVE_WORDS = "soar soars soared surge surges surged record best rally rallied"
INTENSIFIER_WORDS = "sharp sharply steep steeply heavy heavily massive biggest record deep deepest severe brutal"
NEGATOR_WORDS = "not no never without deny denies denied isn't wasn't aren't don't doesn't"
QUESTION_WORDS = "question questions questioned challenges challenge selling"
NEUTRAL_PHRASES = r"\bgains? traction\b|\bpaused?\b.{0,20}\bfor\b"
MOVE_DOWN_VERBS = "down|fell|falls?|drops?|dropped|slid|slides|sank|sinks|lost|loses|lose|plunged|plunges|tumbled|tumbles|declined|declines"
MOVE_UP_VERBS = "up|rose|rises|jumped|jumps|gained|gains|climbed|climbs|soared|soars|surged|surges|rallied|rallies"
MOVE_FILLERS = "about|more than|nearly|almost|over|roughly|some"

# ---- fixed values: stop words, finance context words, denial wording --------------------------
STOP_WORDS = """
a an the of to in on for and or as at by with its is are was were be been after over from this that it into than then
so but not no if about amid says said say new more most just very can could will would may might has have had do does
did up down out off per via vs
"""
FINGERPRINT_STOP_WORDS = "a an the of to in on for and or as at by with its is are after over from this that it be"
CONTEXT_WORDS = """
shares share stock stocks earnings revenue revenues profit profits quarter quarterly guidance outlook dividend buyback
investors investor analyst analysts market markets valuation ceo cfo inc corp company nasdaq nyse sec filing ipo
acquire acquisition merger deal billion million trillion rating downgrade upgrade target targets results sales demand
regulators regulator antitrust lawsuit fined probe unveils iphone cloud chips chip subscribers layoffs factory
supplier suppliers premarket trading traders earnings-call
"""
DENIAL_PATTERN = (
    r"\b(?:den(?:y|ies|ied|ying)|refute[sd]?|debunk(?:s|ed)?|false|fake|fabricated|hoax|baseless|"
    r"unfounded|untrue|not true|no truth|misinformation|disinformation|did not happen|never happened|"
    r"(?:is|are|remain|remains) (?:fully )?(?:open|operational|operating normally)|"
    r"operating normally|no (?:such|explosion|incident|halt|suspension)|"
    r"(?:has|have) not (?:halted|suspended|frozen|limited|paused)|"
    r"(?:not|never) (?:halted|suspended|frozen|limited|paused))\b"
)
# ---- end of fixed values ----------------------------------------------------------------------


@dataclass(frozen=True)
class TextDims:
    """Everything the text operators look up."""

    rules: tuple[tuple[str, str, float, str], ...] = RULES
    items: tuple[tuple[str, str, str, int], ...] = FILING_ITEMS
    positive: frozenset[str] = frozenset(POSITIVE_WORDS.split())
    negative: frozenset[str] = frozenset((NEGATIVE_WORDS + STRONG_NEGATIVE_WORDS).split())
    strong_positive: frozenset[str] = frozenset(STRONG_POSITIVE_WORDS.split())
    strong_negative: frozenset[str] = frozenset(STRONG_NEGATIVE_WORDS.split())
    question: frozenset[str] = frozenset(QUESTION_WORDS.split())
    intensifiers: frozenset[str] = frozenset(INTENSIFIER_WORDS.split())
    negators: frozenset[str] = frozenset(NEGATOR_WORDS.split())
    context: frozenset[str] = frozenset(CONTEXT_WORDS.split())
    denial: str = DENIAL_PATTERN
    stop: frozenset[str] = frozenset(STOP_WORDS.split())
    fingerprint_stop: frozenset[str] = frozenset(FINGERPRINT_STOP_WORDS.split())


FINANCE = TextDims()
