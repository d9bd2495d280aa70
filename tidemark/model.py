"""The inspection graph as tables: fixed values and schemas."""

from __future__ import annotations

# The labels that frames are scored for, in the order in which keywords are listed.
LABELS = ("anode", "bilge_keel", "sea_chest_grating", "defect", "corrosion", "marine_growth", "over_board_valve", "paint_peel", "propeller")
DEFECTS = ("defect", "corrosion", "marine_growth", "paint_peel")
# The part that a label depicts.
DEPICTS = {"anode": "102.2", "over_board_valve": "631.1", "propeller": "413", "sea_chest_grating": "632.332", "bilge_keel": "465"}
# The part hierarchy, as code and code of the parent; '' is the ship.
PARTS = [
    ("100", ""), ("102.1", "100"), ("102.2", "100"), ("111", ""), ("173.1", ""), ("412.72", ""), ("412.723", "412.72"), ("412.725", "412.72"), ("413", ""), ("413.2", "413"),
    ("421", ""), ("421.2", "421"), ("421.3", "421"), ("421.4", "421"), ("421.5", "421"), ("433", ""), ("433.2", "433"), ("440", ""), ("460", ""), ("464.1", "460"), ("465", "460"),
    ("631", ""), ("631.1", "631"), ("632", ""), ("632.332", "632"),
]
TELEMETRY = ("pitch", "roll", "camera_tilt", "heading", "depth", "rangefinder", "longitude", "latitude")

SCHEMAS = {
    "ships": "ship_id INT, imo STRING, name STRING, type STRING, marine_traffic_url STRING",
    "parts": "ship_id INT, vis_code STRING, parent_vis_code STRING, name STRING",
    "inspections": "inspection_id INT, imo STRING, date STRING, ship_heading DOUBLE",
    "frames": "frame_id STRING, inspection_id INT, imo STRING, framenumber DOUBLE, frame_index DOUBLE, thumbnail STRING, uciqe DOUBLE, " + ", ".join(f"{t} DOUBLE" for t in TELEMETRY) + ", " + ", ".join(f"{x} INT, {x}_classification DOUBLE, {x}_segmentation DOUBLE" for x in LABELS),
    "mosaics": "mosaic_id STRING, start_frame DOUBLE, end_frame DOUBLE, x_dim INT, y_dim INT, size_increase DOUBLE, image_file STRING, seg_image_file STRING, percentages MAP<STRING,DOUBLE>, coco MAP<STRING,STRUCT<size:ARRAY<INT>,counts:BINARY>>",
    "clusters": "cluster_id STRING, inspection_id INT, number INT",
    "depicts": "frame_id STRING, ship_id INT, vis_code STRING, segmentation DOUBLE, classification DOUBLE",
    "in_mosaic": "frame_id STRING, mosaic_id STRING, homography ARRAY<DOUBLE>",
    "in_cluster": "frame_id STRING, cluster_id STRING",
    "similar": "src STRING, dst STRING, visual BOOLEAN, distance DOUBLE",
    "metadata": "inspection_date STRING, ship_name STRING, imo STRING, ship_type STRING, marine_traffic_url STRING",
}
