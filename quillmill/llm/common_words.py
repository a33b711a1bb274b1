"""Frequent function words of the project's languages, and a compact expression for a word set."""

from __future__ import annotations

#: Ordinary function words, the usual stop-word lists shortened.
WORDS = {
    "en": "the a an of that and to in is are was were be been it its his her their our your my you he she we they i this these those one every another some any not no but or if even as at by for from on with without into over under about after before while because when whenever until unless since once than then there here who whoever which what where how all more most such only own same so too very can will just do does did has have had would could should may might".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder aber ist sind war nicht wir ich du er sie es uns ihr sich mit von zu zum zur im in am an auf aus bei nach vor wenn weil dass wie als auch noch nur so für über unter um bis durch ohne jeder jede alle wir man".split(),
    "es": "el la los las un una unos unas de del y o pero es son no se que en a al con por para sin su sus lo le nos me te mi tu nuestro nuestros como más ya muy cuando hasta aunque este esta esto entre sobre tras".split(),
    "fr": "le la les un une des de du et ou mais est sont ne pas se que qui en à au aux avec par pour sans son sa ses lui nous vous je tu il elle on ce cette ces notre nos comme plus dans sur entre quand si avant après tout toute".split(),
}


def all_words() -> list[str]:
    return sorted({w for ws in WORDS.values() for w in ws})


def trie_pattern(words: list[str]) -> str:
    """An expression that matches exactly the words given, sharing prefixes (fast in backtracking engines)."""
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def build(node: dict) -> str:
        parts = [ch + build(nxt) for ch, nxt in sorted(node.items()) if ch]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and "" not in node else "(?:" + "|".join(parts) + ")"
        return body + ("?" if "" in node else "")

    return build(root)
