"""The standard catalogue of equipment and point labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schema

#: Equipment -> label -> alternatives, each a list of tokens, in order.
EQUIPMENT = {
    "AHU": {
        "MixedAirTemp(AHU)": ["MA T", "MA TP", "MAT", "MIXED AIR TEMP", "AHU MA T", "AHU MAT"],
        "MixedAirDamper(AHU)": ["MA PS", "MA P", "MA POS", "MA DMP", "MIXED DAMPER POSITION", "AHU MA PS", "AHU MA DAMP POS"],
        "ReturnAirTemp(AHU)": ["RA T", "RA TP", "RAT", "RETURN AIR TEMP", "AHU RA T", "AHU RETURN TEMP"],
        "ReturnAirDamper(AHU)": ["RA POS", "RA DMP", "RA PS", "RETURN DAMPER POSITION", "AHU RA POS", "AHU RETURN POS"],
        "OutdoorAirTemp(AHU)": ["OA T", "OAT", "OUTDOOR AIR TEMP", "AHU OA T", "AHU OUTDOOR TEMP"],
        "Humidity(AHU)": ["RH", "HUM", "AIR HUMIDITY", "AHU RH", "AHU HUM"],
    },
    "VAV": {
        "ZoneTemp(VAV)": ["ZN T", "ZN TEMP", "ZONE TEMP", "ROOM TEMP", "VAV ZN T", "VAV ZONE TEMP"],
        "DamperPosition(VAV)": ["ZN POS", "ZN DMP", "ZN PS", "ZONE DAMPER", "ROOM DAMPER", "VAV ZN POS", "VAV ZONE POS"],
        "SetPoint(VAV)": ["ZN SP", "ZN SET", "ZONE SP", "SET TEMP", "ROOM SET TEMP", "VAV ZN SP", "VAV ZONE STP"],
        "Occupancy(VAV)": ["OCC", "OCCUPANCY", "OCCUPANT", "ROOM OCC", "VAV OCC", "VAV OCCUPANT"],
        "Humidity(VAV)": ["RH", "HUM", "AIR HUMIDITY", "ZONE HUMIDITY", "ROOM HUMIDITY", "VAV RH", "VAV HUM"],
    },
    "VRF": {
        "ZoneTemp(VRF)": ["ZN T", "ZN TEMP", "ZONE TEMP", "ROOM TEMP", "VRF ZN T", "VRF ZN T"],
        "OutdoorTemp(VRF)": ["OA TEMP", "OAT", "OUT TEMP", "ODR TEMP", "OUTDOOR TEMP", "VRF OA T", "VRF OAT"],
        "SetPoint(VRF)": ["ZN SP", "ZN SET", "ZONE SP", "SET TEMP", "ROOM SET TEMP", "VRF ZN SP", "VRF RM SP"],
        "Occupancy(VRF)": ["OCC", "OCCUPANCY", "OCCUPANT", "ROOM OCC", "VRF OCC", "VRF OCCUPANT"],
        "Humidity(VRF)": ["RH", "HUM", "AIR HUMIDITY", "ZONE HUMIDITY", "ROOM HUMIDITY", "VRF RH", "VRF HUM"],
    },
}
#: Further alternatives of the same labels, used when points are labelled.
POINTS = {
    "AHU": {
        "MixedAirTemp(AHU)": ["MA T", "MA TP", "MAT", "AHU MA T", "AHU MAT"],
        "MixedAirDamper(AHU)": ["MA PS", "MA P", "MA POS", "MA DMP", "AHU MA PS", "AHU MA DAMP POS"],
        "ReturnAirTemp(AHU)": ["RA T", "RA TP", "RAT", "AHU RA T", "AHU RETURN TEMP"],
        "ReturnAirDamper(AHU)": ["RA POS", "RA DMP", "RA PS", "AHU RA POS", "AHU RETURN POS"],
        "OutdoorAirTemp(AHU)": ["OA T", "OAT", "AHU OA T", "AHU OUTDOOR TEMP"],
        "Humidity(AHU)": ["RA H", "HUM", "AHU RH", "AHU HUM"],
    },
    "VAV": {
        "ZoneTemp(VAV)": ["ZN T", "ZN TEMP", "ZONE TEMP", "VAV ZN T", "VAV ZONE TEMP"],
        "DamperPosition(VAV)": ["ZN POS", "ZN DMP", "ZN PS", "VAV ZN POS", "VAV ZONE POS"],
        "SetPoint(VAV)": ["ZN SP", "ZN SET", "ZONE SP", "VAV ZN SP", "VAV ZONE STP"],
        "Occupancy(VAV)": ["OCC", "OCCPANCY", "VAV OCC", "VAV OCCUPANT"],
        "Humidity(VAV)": ["RH", "HUM", "VAV RH", "VAV HUM"],
    },
    "VRF": {
        "ZoneTemp(VRF)": ["ZN T", "ZN TEMP", "ZONE TEMP", "ROOM TEMP", "ODU ZN T", "ODU ZN T"],
        "OutdoorTemp(VRF)": ["OA TEMP", "OAT", "OUT TEMP", "ODR TEMP", "OUTDOOR TEMP", "VRF OA T", "VRF OAT"],
        "SetPoint(VRF)": ["ZN SP", "ZN SET", "ZONE SP", "SET TEMP", "ROOM SET TEMP", "VRF ZN SP", "VRF RM SP"],
        "Occupancy(VRF)": ["OCC", "OCCUPANCY", "OCCUPANT", "ROOM OCC", "VRF OCC", "VRF OCCUPANT"],
        "Humidity(VRF)": ["RH", "HUM", "AIR HUMIDITY", "ZONE HUMIDITY", "ROOM HUMIDITY", "VRF RH", "VRF HUM"],
    },
}

Model = dict[str, dict[str, list[list[str]]]]


def equipment_model() -> Model:
    return {equip: {label: [alt.split(" ") for alt in alts] for label, alts in labels.items()} for equip, labels in EQUIPMENT.items()}


def point_model(merge: str = "nested") -> Model:
    """Equipment alternatives with the point alternatives behind them.

    "nested" appends a label's point alternatives as one alternative whose
    tokens are the printed lists, which matches next to nothing; "flat" adds
    each as an alternative.
    """
    model = equipment_model()
    for equip, labels in POINTS.items():
        for label, alts in labels.items():
            lists = [alt.split(" ") for alt in alts]
            model[equip].setdefault(label, []).extend([[str(x) for x in lists]] if merge == "nested" else lists)
    return model


def catalog(spark: SparkSession, model: Model | None = None) -> DataFrame:
    """One row an alternative; a constant of a few hundred rows."""
    rows = [
        (equip, i, label, j, k, alt)
        for i, (equip, labels) in enumerate((model or equipment_model()).items())
        for j, (label, alts) in enumerate(labels.items())
        for k, alt in enumerate(alts)
    ]
    return spark.createDataFrame(rows, schema.CATALOG)


def class_labels(unknown: str = "UNKNOWN") -> list[str]:
    return [unknown, *EQUIPMENT]


def point_labels(unknown: str = "UNKNOWN") -> list[str]:
    return [unknown, *(label for labels in point_model().values() for label in labels)]


def class_codes() -> dict[str, int]:
    """Codes from 1; 0 stands for any other label."""
    return {equip: i for i, equip in enumerate(EQUIPMENT, 1)}
