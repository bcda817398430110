"""Table schemas of the part model. Lists of a document become tables keyed by manifest_id."""

from __future__ import annotations

TRANSFORM = "struct<translation:array<double>,rotation_quat:array<double>,scale:array<double>>"
FINGERPRINT = "struct<bbox_min:array<double>,bbox_max:array<double>,volume_mm3:double,surface_area_mm2:double,topology_hash:string,vertex_count:int,face_count:int>"
MATERIAL = "struct<name:string,base_color:array<double>,metallic:double,roughness:double,emissive:array<double>,alpha_mode:string,base_color_texture:string,normal_texture:string,metallic_roughness_texture:string,occlusion_texture:string,emissive_texture:string,opacity_texture:string>"
LABEL = "struct<fastener_type:string,standard:string,variant:string,confidence:double,method:string,dims:map<string,double>,top3:array<struct<cls:string,prob:double>>>"
PART = f"struct<uuid:string,name:string,original_name:string,parent_uuid:string,transform:{TRANSFORM},local_transform:{TRANSFORM},fingerprint:{FINGERPRINT},material:{MATERIAL},detection:{LABEL},tags:array<string>,metadata:map<string,string>>"
RELATIONSHIP = "struct<kind:string,subject_uuid:string,target_uuid:string,params:map<string,string>,inferred:boolean,confidence:double,broken:boolean>"
PMI = "struct<kind:string,target_uuid:string,value:string,plane:array<double>>"
META = "struct<version:string,created_at:timestamp,modified_at:timestamp,source:string,coordinate_system:string,units:string>"
MANIFEST = f"meta {META}, parts array<{PART}>, relationships array<{RELATIONSHIP}>, global_pmi array<{PMI}>, unmatched_on_return array<string>, conflict_log array<map<string,string>>"
EVENT = "event string, id string, ts timestamp, payload map<string,string>"

# Domains of the enumerated columns.
DOMAINS = {
    "relationship.kind": ("fastener", "mate", "contact", "weld", "bond", "contained_in", "custom"),
    "alpha_mode": ("OPAQUE", "MASK", "BLEND"),
    "label.method": ("rule_based", "ml_pointnet", "ml_brepformer", "ensemble"),
}
