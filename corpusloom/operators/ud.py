"""Dependency trees of an older treebank scheme as Universal Dependencies: tags, features, relations, shape."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each place of a nine-place tag says.
POS = {"a": "ADJ", "c": "CCONJ", "d": "ADV", "g": "PART", "i": "INTJ", "l": "DET", "m": "NUM", "n": "NOUN", "p": "PRON", "r": "ADP", "u": "PUNCT", "v": "VERB", "x": "X"}
PLACES = {
    2: {"Person": {"1": "1", "2": "2", "3": "3"}},
    3: {"Number": {"d": "Dual", "p": "Plur", "s": "Sing"}},
    4: {"Tense": {"a": "Past", "f": "Fut", "i": "Past", "l": "Pqp", "p": "Pres", "r": "Pres", "t": "Fut"}, "Aspect": {"a": "Perf", "i": "Imp", "r": "Perf", "t": "Perf"}},
    5: {"Mood": {"i": "Ind", "s": "Sub", "o": "Opt", "m": "Imp"}, "VerbForm": {"i": "Fin", "s": "Fin", "o": "Fin", "m": "Fin", "n": "Inf", "p": "Part", "g": "Gdv"}},
    6: {"Voice": {"a": "Act", "m": "Mid", "p": "Pass", "e": "Mid"}},
    7: {"Gender": {"c": "Com", "f": "Fem", "m": "Masc", "n": "Neut"}},
    8: {"Case": {"a": "Acc", "d": "Dat", "g": "Gen", "n": "Nom", "v": "Voc"}},
    9: {"Degree": {"c": "Cmp", "s": "Sup"}},
}
#: Relations that change by name alone, and letters of another script in two of them.
HOMOGLYPHS = {"AuxΖ": "AuxZ", "AuxΚ": "AuxK"}
RELATIONS = {
    "SBJ": "nsubj", "OBJ": "obj", "OCOMP": "obj", "APOS": "appos", "AuxC": "mark", "AuxV": "aux", "AuxG": "punct", "AuxK": "punct", "AuxX": "punct",
    "AuxR": "expl", "AuxY": "cc", "AuxZ": "advmod", "ATV": "xcomp", "AtvV": "xcomp", "ExD": "orphan", "MWE": "fixed", "PRED": "root",
}
STOPS = ("AuxG", "AuxK", "AuxX")
DONE = ("cc", "conj", "case", "cop", "dep", "obl")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def upos(xpos: Column) -> Column:
    """Universal part of speech of a tag: by its first place, X where that is unknown."""
    return F.coalesce(F.try_element_at(_map(POS), F.substring(xpos, 1, 1)), F.lit("X"))


def features(xpos: Column) -> Column:
    """Map of universal features of a tag; places that say nothing give none."""
    pairs = [F.struct(F.lit(name).alias("k"), F.try_element_at(_map(values), F.substring(xpos, at, 1)).alias("v")) for at, said in PLACES.items() for name, values in said.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["v"].isNotNull()))


def feature_string(feats: Column) -> Column:
    """Name=Value, sorted by name, parted by bars; an underscore for none."""
    said = F.array_sort(F.transform(F.map_entries(feats), lambda x: F.concat_ws("=", x["key"], x["value"])))
    return F.when(F.size(said) > 0, F.array_join(said, "|")).otherwise("_")


def relation(deprel: Column, native: Column) -> Column:
    """The universal name of a relation that keeps its place in the tree; unknown ones stay."""
    name = F.coalesce(F.try_element_at(_map(HOMOGLYPHS), deprel), deprel)
    attribute = F.when(native == "l", "det").when(native == "a", "amod").otherwise("nmod")
    adverbial = F.when(native == "d", "advmod").when(native == "v", "advcl").otherwise("obl")
    plain = F.coalesce(F.try_element_at(_map(RELATIONS), name), name)
    return F.when(name.isin(*DONE), name).when(name == "ATR", attribute).when(name == "ADV", adverbial).otherwise(plain)


class Tree:
    """Heads and relations of one sentence, places from 1; 0 is above the root."""

    def __init__(self, head: list[int], rel: list[str | None]):
        self.head = [0, *(int(h or 0) for h in head)]
        self.rel = [None, *(HOMOGLYPHS.get(r, r) for r in rel)]

    def under(self, v: int) -> list[int]:
        return [i for i in range(1, len(self.head)) if self.head[i] == v]

    def named(self, name: str) -> list[int]:
        return [i for i in range(1, len(self.rel)) if self.rel[i] == name]

    def swap(self, above: int, below: int, new: str, old: str | None) -> None:
        """`below` takes the place of `above`, which goes under it; `new` and `old` are their relations then."""
        self.head[below], self.head[above] = self.head[above], below
        self.rel[below], self.rel[above] = new, old

    def reshape(self) -> Tree:
        """Coordinations are headed by their first member, prepositions go under their noun, copulas under the predicate."""
        for v in self.named("COORD"):
            members = self.under(v)
            if members:
                self.swap(v, members[0], "dep", "cc")
                for k in members[1:]:
                    self.head[k] = members[0]
                    if self.rel[k] not in STOPS:
                        self.rel[k] = "conj"
        for v in self.named("AuxP"):
            inside = self.under(v)
            if inside:
                self.swap(v, inside[0], "obl", "case")
                for k in inside[1:]:
                    self.head[k] = inside[0]
        for v in self.named("PNOM"):
            verb = self.head[v]
            if verb:
                self.swap(verb, v, "root" if self.rel[verb] == "PRED" else self.rel[verb], "cop")
                for k in self.under(verb):
                    if k != v:
                        self.head[k] = v
        return self


def universal(tokens: DataFrame, sent: str = "sent", order: str = "id") -> DataFrame:
    """Adds ud_upos, ud_feats, ud_head, ud_deprel to (sent, id from 1, xpos, upos native, head, deprel). A sentence is
    reshaped as a whole, one group a sentence; tags, features and names are column expressions."""
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        tree = Tree(pdf["head"].tolist(), pdf["deprel"].tolist()).reshape()
        return pdf[[sent, order]].assign(ud_head=tree.head[1:], ud_deprel=tree.rel[1:])

    shaped = tokens.select(sent, order, "head", "deprel").groupBy(sent).applyInPandas(run, f"{sent} {kinds[sent]}, {order} {kinds[order]}, ud_head int, ud_deprel string")
    out = tokens.join(shaped, [sent, order]).withColumn("ud_deprel", relation(F.col("ud_deprel"), F.col("upos")))
    tag = upos(F.col("xpos"))
    return out.withColumn("ud_upos", F.when((F.col("ud_deprel") == "mark") & (tag == "CCONJ"), "SCONJ").otherwise(tag)).withColumn("ud_feats", features(F.col("xpos")))


def encodable_tree(tokens: DataFrame, keep: str, sent: str = "sent", order: str = "id") -> DataFrame:
    """Tokens that `keep` marks, renumbered, with heads in the new numbers; a token whose head is not kept has null."""
    rows = tokens.where(F.col(keep)).select(sent, F.col(order).alias("old"), "head", "deprel", F.expr(f"row_number() over (partition by {sent} order by {order})").alias("new"))
    up = rows.select(sent, F.col("old").alias("head"), F.col("new").alias("new_head"))
    out = rows.join(up, [sent, "head"], "left")
    return out.select(sent, "old", "new", F.when(F.col("head") == 0, F.lit(0)).otherwise(F.col("new_head")).alias("new_head"), "deprel")
