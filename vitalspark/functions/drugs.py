"""Drug names and classes, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Recognised drugs of each class.
TKI = "osimertinib gefitinib erlotinib afatinib dacomitinib alectinib lorlatinib crizotinib ceritinib brigatinib entrectinib sotorasib adagrasib selpercatinib capmatinib tepotinib dabrafenib trametinib".split()
IO = "pembrolizumab nivolumab atezolizumab durvalumab cemiplimab ipilimumab tremelimumab".split()
CHEMO = "carboplatin cisplatin pemetrexed paclitaxel nab-paclitaxel docetaxel gemcitabine vinorelbine etoposide bevacizumab ramucirumab".split()
ONCOLOGY = (*TKI, *IO, *CHEMO)


def drug_name(name: Column) -> Column:
    return F.lower(F.trim(name))


def drug_class(name: Column, canonical_class: Column | None = None) -> Column:
    """tki, io or chemo: by name, else by the prefix of a finer class, else chemo."""
    n = drug_name(name)
    fine = F.lower(F.lit(None).cast("string") if canonical_class is None else canonical_class)
    return (
        F.when(n.isin(*TKI), "tki").when(n.isin(*IO), "io").when(n.isin(*CHEMO), "chemo")
        .when(fine.startswith("tki"), "tki").when(fine.startswith("io"), "io").otherwise("chemo")
    )


def regimen_class(classes: Column) -> Column:
    """Class of a regimen from the array of its drugs' classes."""

    def has(*names: str) -> Column:
        out = F.array_contains(classes, names[0])
        for name in names[1:]:
            out = out & F.array_contains(classes, name)
        return out

    return F.when(has("tki", "io"), "tki+io").when(has("tki", "chemo"), "tki+chemo").when(has("chemo", "io"), "chemo+io").when(has("tki"), "tki").when(has("io"), "io").otherwise("chemo")
