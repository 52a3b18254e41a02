"""Input widgets: metadata that rides on operator inputs (and on StructField.metadata), never a constraint.

Two have effects when a flow is lowered: ConnectionList inputs gather labelled values into a map, and a HumanReview
input pauses a run after its node.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

#: Each widget's schema name, handle type, and options with their defaults.
WIDGETS: dict[str, tuple[str, str, dict[str, Any]]] = {
    "Text": ("text", "str", {"min_length": None, "max_length": None, "pattern": None}),
    "Textarea": ("textarea", "str", {"rows": 4, "min_length": None, "max_length": None}),
    "Dropdown": ("dropdown", "str", {"choices": ()}),
    "DependentDropdown": ("dependent_dropdown", "str", {"depends_on": None, "choices_map": None}),
    "Range": ("range", "float", {"min_val": 0, "max_val": 100, "step": 1}),
    "Checkbox": ("checkbox", "bool", {}),
    "FileUpload": ("file_upload", "base64str", {"accept": None, "max_size_mb": None, "multiple": False}),
    "ConnectionList": ("connection_list", "dict", {}),
    "Output": ("output", "any", {"download": False, "filename": None}),
    "Number": ("number", "float", {"min_val": None, "max_val": None, "step": None, "integer_only": False}),
    "Switch": ("switch", "bool", {}),
    "HumanReview": ("human_review", "bool", {"prompt": None}),
    "DatePicker": ("date_picker", "date", {"min_date": None, "max_date": None}),
    "Multiselect": ("multiselect", "list[str]", {"choices": (), "min_selected": None, "max_selected": None}),
    "List": ("list", "list", {"item_widget": None, "min_items": None, "max_items": None}),
    "SchemaBuilder": ("schema_builder", "dict", {"schema": None, "allow_additional": True}),
    "CodeEditor": ("code_editor", "str", {"language": None, "min_length": None, "max_length": None}),
    "TemplateTextarea": ("template_textarea", "str", {"rows": 4, "variables": ()}),
    "EntityDropdown": ("entity_dropdown", "str", {"entity_kind": None, "multiple": False}),
    "IfElseBuilder": ("if_else_builder", "any", {"variables": ()}),
    "TableSource": ("table_source", "any", {}),
    "ConditionBuilder": ("condition_builder", "list", {"connection_input": None}),
    "Tags": ("tags", "list[str]", {}),
    "ColumnSelect": ("column_select", "str", {"depends_on": None}),
    "TableInput": ("table_input", "dict", {"min_rows": None, "min_columns": None}),
}
#: Options whose name in the schema differs.
SCHEMA_NAMES = {("Range", "min_val"): "range_min", ("Range", "max_val"): "range_max", ("EntityDropdown", "entity_kind"): "entity_type"}


@dataclass(frozen=True)
class Widget:
    kind: str
    label: str = ""
    description: str = ""
    disable_handle: bool = False
    hidden_when: Any = None
    advanced: bool = False
    options: tuple[tuple[str, Any], ...] = ()

    def schema(self) -> dict[str, Any]:
        out = {"widget": WIDGETS[self.kind][0], "label": self.label, "description": self.description, "disable_handle": self.disable_handle}
        if self.hidden_when is not None:
            out["hidden_when"] = self.hidden_when
        if self.advanced:
            out["advanced"] = True
        out |= {SCHEMA_NAMES.get((self.kind, k), k): list(v) if isinstance(v, tuple) else v for k, v in self.options if v is not None}
        return out


def widget(kind: str, label: str = "", description: str = "", disable_handle: bool = False, hidden_when: Any = None, advanced: bool = False, **options: Any) -> Widget:
    """A widget by name; unknown names and options are errors."""
    if kind not in WIDGETS:
        raise ValueError(f"no widget {kind!r}")
    known = WIDGETS[kind][2]
    if extra := options.keys() - known.keys():
        raise ValueError(f"{kind} has no option {', '.join(sorted(extra))}")
    return Widget(kind, label, description, disable_handle, hidden_when, advanced, tuple(sorted((known | options).items())))


def default_widget(type_name: str) -> Widget:
    """The widget that an input of a type has unless it names one."""
    known = {"str": "Text", "int": "Number", "float": "Number", "bool": "Checkbox", "date": "DatePicker", "base64str": "FileUpload", "namedfile": "FileUpload", "multinamedfile": "FileUpload"}
    kind = known.get(type_name) or ("List" if type_name.startswith("list") else "SchemaBuilder" if type_name.startswith("dict") else "Text")
    return widget(kind, integer_only=True) if type_name == "int" else widget(kind, multiple=True) if type_name == "multinamedfile" else widget(kind)
