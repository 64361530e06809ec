"""The two published formula catalogues, one recipe per formula."""

from tessera.plans.catalogue.first import FORMULAS as FIRST
from tessera.plans.catalogue.second import FORMULAS as SECOND

# Named lists; a factor is called <list>_<three-digit number>.
CATALOGUES = {"alpha101": FIRST, "alpha191": SECOND}


def recipes(catalogue: str) -> dict:
    """Factor name to recipe, in list order."""
    return {f"{catalogue}_{number:03d}": recipe for number, recipe in sorted(CATALOGUES[catalogue].items())}
