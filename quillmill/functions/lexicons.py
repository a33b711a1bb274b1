"""Word lists and patterns the text rules depend on.

FIXED VALUES: the results of the rules are defined by these lists, so they are stated as they are,
in their usual order. Every operator takes them as parameters; these are the defaults.
"""

from __future__ import annotations

META_STRUCTURAL = [
    r"in this chapter we will",
    r"in this chapter,? we",
    r"as discussed earlier",
    r"as mentioned (earlier|above|before|previously)",
    r"in the previous (section|chapter)",
    r"this book will explore",
    r"let us now turn to",
    r"we will (now )?(explore|examine|discuss|consider)",
    r"this (section|chapter) (will )?(cover|discuss|explore)",
    r"as we (will |shall )see",
    r"in the (next|following) (section|chapter)",
    r"to summarize (this|the) (section|chapter)",
    r"before we (proceed|continue|begin)",
]

INDEX_REFERENCE = [
    r"\d{1,3}\s*[-–]\s*\d{1,3}",
    r"\([A-Z][a-z]+,?\s*\d{4}\)",
    r"\[\d+\]",
    r"ibid\.",
    r"op\.\s*cit\.",
    r"et\s+al\.",
    r"pp?\.\s*\d+",
    r"see\s+also\s+chapter",
    r"cf\.\s+",
]

BIOGRAPHY = [
    r"was born (in|on)",
    r"died (in|on)",
    r"graduated from",
    r"received (his|her|their) (degree|diploma)",
    r"married .+ in \d{4}",
    r"had \d+ children",
    r"moved to .+ in \d{4}",
    r"joined .+ (in|as) \d{4}",
]

ACADEMIC = [
    r"research shows",
    r"research (has )?(shown|demonstrated|found|revealed)",
    r"studies (show|suggest|indicate|demonstrate|reveal)",
    r"study (shows?|suggests?|indicates?|found)",
    r"evidence (indicates?|suggests?|shows?)",
    r"data (reveals?|shows?|suggests?|indicates?)",
    r"experiments? (show|demonstrate|reveal|found)",
    r"scientists (have )?(found|discovered|shown)",
    r"researchers (have )?(found|discovered|shown)",
    r"according to (research|studies|data|evidence)",
    r"the (findings|results) (show|indicate|suggest)",
    r"empirical (evidence|research|data)",
    r"meta-analysis",
    r"randomized (controlled )?trial",
    r"statistically significant",
]

CONTRARIAN = [
    r"most people (think|believe|assume)",
    r"people (often )?(assume|think|believe)",
    r"the common (assumption|belief|wisdom)",
    r"conventional wisdom (says|suggests|holds)",
    r"nobody talks about",
    r"rarely (discussed|mentioned|acknowledged)",
    r"the real reason",
    r"the uncomfortable truth",
    r"the hidden (truth|reality|reason)",
    r"this is why",
    r"what actually (matters|works|happens)",
    r"the (real|actual|true) (problem|issue|reason)",
    r"contrary to (popular belief|what)",
    r"(but|yet) (here'?s|the) (thing|truth|reality)",
    r"what (most|many) (people|folks) (don'?t|miss|overlook)",
    r"the counterintuitive",
    r"paradoxically",
]

MEANING = [
    r"this (means|shows|demonstrates|proves|reveals) that",
    r"the (key )?(lesson|insight|takeaway|point) (is|here)",
    r"the (reason|explanation) (is|for this)",
    r"the (mistake|error|problem) (is|most people make)",
    r"what (this|we) (learn|discover|realize|understand)",
    r"what (works|matters|counts) (is|here)",
    r"this (explains?|illustrates?) (why|how)",
    r"the (pattern|principle|rule) (is|here)",
    r"in other words",
    r"put (simply|differently|another way)",
    r"the bottom line",
    r"ultimately",
    r"the implication (is|here)",
    r"the consequence (is|of this)",
    r"the (fundamental|core|essential) (truth|insight|lesson)",
]

IMPLICIT_INSIGHT = [
    r"because of this",
    r"as a result",
    r"therefore",
    r"consequently",
    r"this (leads?|led) to",
    r"the (effect|impact|result) (is|was)",
    r"which (means|explains|shows)",
    r"and (so|thus)",
    r"for this reason",
    r"that'?s (why|how|what)",
    r"hence",
    r"thus",
    r"accordingly",
]

SIGNALS = {"academic": ACADEMIC, "contrarian": CONTRARIAN, "meaning": MEANING, "implicit_insight": IMPLICIT_INSIGHT}

EARLY_CLOSE = [
    r"(?:the (?:key|crucial|important|essential) (?:point|insight|lesson|takeaway) is)",
    r"(?:this (?:shows|demonstrates|proves|reveals|means) that)",
    r"(?:in other words|put simply|the bottom line|ultimately)",
    r"(?:what (?:this|we) (?:learn|discover|realize|understand))",
    r"(?:and that(?:'s| is) (?:why|how|what))",
    r"(?:this is (?:the|why|how|what))",
    r"(?:the (?:result|outcome|consequence|implication) (?:is|was))",
]

EXPLAINER_STARTERS = [
    r"^this is because\b",
    r"^the reason (is|being|for)\b",
    r"^for example\b",
    r"^in other words\b",
    r"^to (understand|illustrate|explain)\b",
    r"^as (mentioned|discussed|noted)\b",
    r"^consider (the|how|why)\b",
    r"^let me explain\b",
]

KILL = [
    r"^this chapter\b",
    r"^in (this|the following) section\b",
    r"^let('s| us) (begin|start) (by|with)\b",
    r"^(table|figure|chart) \d",
    r"as mentioned earlier",
    r"as we (discussed|saw|learned|noted)",
    r"in (the )?(previous|next|following) (chapter|section)",
    r"copyright( act)?.*\d{4}",
    r"all rights reserved",
    r"permission of the publisher",
    r"without (the )?(prior )?(written )?permission",
    r"scanning.*uploading.*electronic sharing",
    r"ISBN[:\s]*[\d\-]+",
    r"Library of Congress",
    r"Printed in (the )?United States",
    r"First (published|edition|printing)",
]

EMOTIONAL = (
    "pain fear anxiety stress worry panic dread terrified scared desperate trapped stuck lost "
    "obsess crave desire want need yearn hunger addicted compelled driven consumed "
    "hate anger rage frustration disgust shame guilt regret jealousy envy bitter resentment "
    "love joy hope pride confident free relief excited passionate inspired grateful "
    "secret truth lie hidden reveal expose discover mistake fail destroy ruin transform breakthrough "
    "never always forever impossible guaranteed dangerous wrong real ignore cost lose "
    "hard difficult easy simple important critical must struggle fight win success "
    "distraction focus shallow deep valuable rare urgent busy productive wasted meaningless "
    "meaningful significant trivial crucial essential overwhelm clarity confusion purpose impact "
    "mediocre exceptional ordinary extraordinary elite effort reward sacrifice commitment "
    "resist temptation discipline willpower habit change powerful weak strength"
).split()

STRONG_OPENERS = ["you", "your", "most", "few", "the problem", "the truth", "the real", "here's", "this is", "what", "why", "how", "imagine", "consider", "stop", "start", "never", "always", "don't", "if you"]

CONTRAST_OPENING = ["but", "yet", "however", "instead", "actually", "really"]
CONTRAST_TENSION = ["but", "yet", "however", "although", "despite", "instead"]
NEGATIONS = ["not", "don't", "doesn't", "never", "no one", "nothing", "nobody"]
BLAME = ["you", "they", "society", "culture", "schools", "parents", "system", "world"]

TRIBAL = [
    "most people", "few people", "the difference between",
    "successful people", "the best", "the worst",
    "winners", "losers", "those who", "the ones who",
    "amateurs", "professionals", "beginners", "masters",
    "average", "exceptional", "ordinary", "extraordinary",
    "the masses", "the elite", "common mistake",
]

ASPIRATION = ["elite", "rare", "secret", "hidden", "real", "truth", "exclusive", "insider", "few know", "most miss", "counterintuitive", "surprising", "unexpected"]

IDENTITY_COST = [
    r"if you (care|respect yourself)",
    r"people who (stay|settle)",
    r"this is why you feel stuck",
    r"most advice fails because",
    r"you're not unlucky",
    r"you're not lazy",
    r"it's not about (luck|talent)",
    r"the reason you (fail|struggle|can't)",
]

CONTEXT_STARTERS = ["he ", "she ", "it ", "they ", "this ", "that ", "these ", "those "]
IMPERATIVE_STARTERS = ["stop", "start", "never", "always", "remember", "forget", "don't", "do"]

CONCRETE_NOUNS = (
    "time money work job habits people decisions life hours days years energy focus attention results "
    "goals success failure pain fear brain mind body morning night routine task project deadline boss "
    "family friends health wealth career business skill"
).split()

ACTION_VERBS = (
    "stop start build avoid choose quit leave make take give do change create destroy break fix "
    "learn teach grow shrink win lose fight run focus ignore accept reject embrace resist commit"
).split()

#: Literal repairs of encoding artefacts, in order.
ENCODING = [("�", ""), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("–", "-"), ("—", "-"), ("…", "..."), ("\xa0", " "), ("\xad", ""), ("ﬁ", "fi"), ("ﬂ", "fl")]

PAGE_NUMBER_LINES = [r"\s*\d{1,4}\s*", r"\s*[Pp]age\s+\d+(\s+of\s+\d+)?\s*", r"\s*[-–—]\s*\d+\s*[-–—]\s*", r"\s*[ivxlcdm]+\s*", r"\s*[IVXLCDM]+\s*"]
TOC_START = [r"\s*table\s+of\s+contents\s*", r"\s*contents\s*"]
TOC_LINE = r".{5,60}[.\s_]{3,}\d{1,4}\s*"
BACK_MATTER = ["bibliography", "references", r"works\s+cited", "index", "endnotes"]
ACKNOWLEDGMENTS = ["acknowledgments?", "acknowledgements?"]
FRONT_CHAPTERS = [r"^chapter\s+\d+", r"^part\s+\d+", r"^introduction\s*$", r"^preface\s*$"]

ARTICLE_JUNK = [
    r"Share this:.*?(?=\n|$)",
    r"Follow us on.*?(?=\n|$)",
    r"Subscribe to.*?(?=\n|$)",
    r"Sign up for.*?(?=\n|$)",
    r"Related posts?:?.*?(?=\n\n|$)",
    r"Tags:.*?(?=\n|$)",
    r"Categories:.*?(?=\n|$)",
    r"Posted in.*?(?=\n|$)",
    r"Leave a comment.*?(?=\n|$)",
    r"Comments \(\d+\)",
    r"Share on (Facebook|Twitter|LinkedIn).*?(?=\n|$)",
]

TRANSCRIPT_JUNK = [r"\[Music\]", r"\[Applause\]", r"\[Laughter\]", r"^\d+:\d+:\d+$", r"^\d+:\d+$"]

VIDEO_URLS = [
    r"(?:https?://)?(?:www\.)?youtube\.com/watch\?v=([a-zA-Z0-9_-]{11})",
    r"(?:https?://)?youtu\.be/([a-zA-Z0-9_-]{11})",
    r"(?:https?://)?(?:www\.)?youtube\.com/embed/([a-zA-Z0-9_-]{11})",
    r"(?:https?://)?(?:www\.)?youtube\.com/shorts/([a-zA-Z0-9_-]{11})",
]

#: H4; the lists of prohibited phrases and weak openers are empty in the reference.
SUMMARY_ENDINGS = ("to sum up", "the takeaway", "remember,", "so remember")
