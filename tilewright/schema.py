"""Schemas of the tables that pass between operators."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
#: Cells in the coordinates of their window; seq is the order in which the source gave them. A row without inst_id says that its window was worked on, and where it failed and why if
#: it did.
DETECTIONS = f"slide_id string, icol int, irow int, inst_id int, seq long, contour array<{POINT}>, top double, down double, left double, right double, cx double, cy double, cell_type string, prob double, stage string, error string"
SLIDES = "slide_id string, path string, width long, height long, properties map<string,string>"
#: Maps of a window, or the stage at which it failed and why.
RAW_MAPS = "slide_id string, icol int, irow int, h int, w int, np array<float>, tp array<short>, hv_h array<float>, hv_v array<float>, stage string, error string"
POLYGON = "struct<cell_id:double,cell_type:string,confidence:double,coordinates:array<array<double>>,centroid:array<double>>"
TILE = f"struct<level:double,x:double,y:double,width:double,height:double,masks:array<{POLYGON}>>"
DOCUMENT = f"model_name string, inference_mpp double, cell_masks array<{TILE}>"
STATUS = "slide_id string, stage string, status string, message string"
