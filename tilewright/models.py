"""Models by name: what a descriptor says of a model, and which provider runs it.

A descriptor is data; weights are not part of this package. `register` joins a descriptor with what makes a provider of its windows; `providers` gives those of some names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .operators.project import OVERLAP, WINDOW
from .operators.pyramid import PARAMETERS

# Cell classes by number, the same for both working resolutions, and the image size that models of each were trained with.
CELL_CLASSES = {
    0: "Background", 1: "Cancer cell", 2: "Lymphocytes", 3: "Fibroblasts", 4: "Plasmocytes", 5: "Eosinophils", 6: "Neutrophils", 7: "Macrophages",
    8: "Muscle Cell", 9: "Endothelial Cell", 10: "Red blood cell", 11: "Epithelial", 12: "Apoptotic Body", 13: "Mitotic Figures", 14: "Minor Stromal Cell",
}
TRAINED_AT = {0.25: 448, 0.5: 224}


@dataclass(frozen=True)
class Descriptor:
    """A model's name, working resolution, the image size it was trained with, its windows and its classes."""

    name: str
    mpp: float
    train_size: int
    tile: int = WINDOW
    overlap: int = OVERLAP
    classes: dict[int, str] = field(default_factory=lambda: dict(CELL_CLASSES))

    def __post_init__(self):
        if self.mpp not in PARAMETERS:
            raise ValueError(f"no parameters for {self.mpp} microns a pixel")
        if not 0 <= 2 * self.overlap < self.tile:
            raise ValueError(f"no core is left of a window of {self.tile} with a margin of {self.overlap}")
        if self.classes.get(0) is None:
            raise ValueError("class 0 is the background")

    @property
    def scale(self) -> float:
        """The side of a window in images of the size that the model was trained with: what position embeddings have to be stretched by."""
        return self.tile / self.train_size


#: The two working resolutions, coarser and finer.
STANDARD = {"segmentor_20x": Descriptor("segmentor_20x", 0.5, TRAINED_AT[0.5]), "segmentor_40x": Descriptor("segmentor_40x", 0.25, TRAINED_AT[0.25])}
_known: dict[str, tuple[Descriptor, Callable]] = {}


def register(descriptor: Descriptor, make: Callable) -> None:
    """make(descriptor) gives a provider with the descriptor's name, mpp, tile, overlap and classes."""
    _known[descriptor.name] = (descriptor, make)


def provider(name: str):
    """The provider of a registered name; one whose windows or classes are not what its descriptor says is an error."""
    if name not in _known:
        raise ValueError(f"no model {name!r}; there are {sorted(_known)}")
    descriptor, make = _known[name]
    made = make(descriptor)
    for field_ in ("name", "mpp", "tile", "overlap", "classes"):
        if getattr(made, field_) != getattr(descriptor, field_):
            raise ValueError(f"{name}: the provider has another {field_} than its descriptor")
    return made


def by_resolution(providers: Iterable) -> dict[float, object]:
    """Providers by mpp; two of one resolution are an error, as a slide could not choose between them."""
    out: dict[float, object] = {}
    for p in providers:
        if p.mpp in out:
            raise ValueError(f"two models of {p.mpp} microns a pixel: {out[p.mpp].name} and {p.name}")
        out[p.mpp] = p
    return out


def table(spark: SparkSession, descriptors: Iterable[Descriptor]) -> DataFrame:
    """(model, mpp, train_size, tile, overlap, cls, cell_type), one row a class: to join class numbers with names."""
    rows = [(d.name, float(d.mpp), d.train_size, d.tile, d.overlap, k, v) for d in descriptors for k, v in sorted(d.classes.items())]
    return spark.createDataFrame(rows, "model string, mpp double, train_size int, tile int, overlap int, cls int, cell_type string")
