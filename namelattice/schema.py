"""Column types of the tables that stages exchange; nothing is inferred."""

POINTS = (
    "point_name string, description string, object_type string, device_id int, device_name string, "
    "object_id string, program_name string, value string, dataset_id string"
)
DATASETS = "dataset_id string, dataset_name string, vendor string, date string, distributor string, site string"
CATALOG = "equip string, equip_ord int, label string, label_ord int, alt_ord int, alt_tokens array<string>"
CLUSTER_FILE = "CLASSES array<struct<LABEL:string,POINTS:array<struct<POINT:array<string>,LABEL:string>>>>"
CONCEPT_POINTS = "concept_id string, rel_path array<string>, label string, score double, point_name string"
