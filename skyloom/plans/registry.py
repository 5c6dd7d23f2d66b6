"""The standard feature set."""

from __future__ import annotations

from skyloom.plans.features import ClassFraction, RadiusFeature, Registry, SurfaceFraction

# Radii, growth phases, land-use classes and road attributes.
RADII = (50, 70, 100)
PHASES = ("Jeugdfase", "Volwassenfase", "Veteranenfase")
LAND_USE_CLASSES: dict[str, tuple[int, ...]] = {
    "dense_built_up": (11100, 11210, 12100),
    "mixed_urban": (11220, 11230, 11240, 11300, 14100, 14200),
    "transport_infrastructure": (12210, 12220, 12230, 12300, 12400),
    "bare_sparse": (13100, 13300, 13400, 33000),
    "vegetation": (21000, 22000, 23000, 24000, 25000, 31000, 32000),
    "water_wetlands": (40000, 50000),
}
ROAD_USES: tuple[str, ...] = (
    "Rijweg", "Parkeerstrook", "Oprit", "Tram- en busbaan",
    "Fietspad", "Voetpad", "Fietspad/voetpad",
    "Beplantingen", "Houtachtigen", "Hagen", "Bermen", "Grasachtigen",
    "Andere", "Kaaimuur", "Waterlichaam",
)
ROAD_MATERIALS: tuple[str, ...] = (
    "Gebakken klinkers", "Betontegels", "Betondallen", "Ineengrijpende Betonstenen", "Betonstenen",
    "Blindengeleidetegels", "Natuursteentegels", "Natuursteendallen", "Natuursteen Platienen",
    "Natuursteen Mozaiek", "Natuursteen Kasseien met gesloten voeg", "Materiaal Beton",
    "Materiaal natuursteen", "Sierverharding Betonproduct", "KWS", "Overlaging",
    "Waterdoorlatende betonstraatstenen", "Grindgazon", "Grasdallen", "Halfharde verharding",
    "Natuursteen Kasseien met open voeg", "Onverhard", "Andere materialen",
)


def classes_of(classes: dict[str, tuple]) -> tuple[tuple[str, tuple[str, ...]], ...]:
    return tuple((name, tuple(str(c) for c in codes)) for name, codes in classes.items())


def build_registry(radii=RADII, phases=PHASES, classes=None, uses=ROAD_USES, materials=ROAD_MATERIALS,
                   use_column: str = "bestemming", material_column: str = "materiaalsoort",
                   phase_column: str = "beheerfase", elevation: str = "elevation") -> Registry:
    """Elevation, planted trees, land-use classes and road surfaces at every radius."""
    reg = Registry()
    for r in radii:
        for agg in ("avg", "max", "min"):
            reg.add(RadiusFeature("dhm", r, agg, (elevation,), temporal="last_previous"))
    for r in radii:
        reg.add(RadiusFeature("trees", r, planted_by=True))
        for phase in phases:
            reg.add(RadiusFeature("trees", r, match=((phase_column, phase),), planted_by=True))
    for r in radii:
        reg.add(ClassFraction(r, classes_of(classes or LAND_USE_CLASSES)))
    for r in radii:
        for value in uses:
            reg.add(SurfaceFraction(use_column, value, r))
        for value in materials:
            reg.add(SurfaceFraction(material_column, value, r))
    return reg
