"""Settings: defaults, presets and profiles, and how they are put together."""

from __future__ import annotations

import copy

# Default settings.
DEFAULTS = {
    "tracing": {
        "colormode": "color", "hierarchical": "stacked", "mode": "spline", "filter_speckle": 4, "color_precision": 6, "layer_difference": 16,
        "corner_threshold": 60, "length_threshold": 10.0, "splice_threshold": 45, "path_precision": 8,
    },
    "preprocessing": {
        "enabled": True, "denoise": True, "denoise_strength": 10, "sharpen": False, "quantize_colors": False, "quantize_n_colors": 16, "quantize_mode": "fixed",
        "quantize_n_colors_min": 8, "quantize_n_colors_max": 64, "quantize_color_space": "lab", "quantize_sample_size": 50000,
    },
    "analysis": {"min_path_area": 2.0, "color_space": "cielab"},
    "clustering": {
        "method": "dbscan", "eps": 0.5, "min_samples": 1,
        "feature_weights": {"position": 1.0, "color": 2.0, "area": 0.5, "complexity": 0.3, "aspect_ratio": 0.3},
    },
    "grouping": {"merge_enabled": True, "proximity_threshold": 50.0, "color_tolerance": 25.0, "min_group_size": 1},
    "hierarchy": {"enabled": True, "containment_method": "geometric", "area_ratio_threshold": 1.1},
    "optimization": {"coordinate_precision": 2, "remove_degenerate": True, "merge_adjacent": True, "simplify_paths": True, "simplify_tolerance": 0.5},
    "output": {"indent": True, "indent_spaces": 2, "add_metadata": True, "add_group_ids": True, "promote_common_attributes": True},
}

# Presets.
PRESETS = {
    "logo": {
        "tracing": {"color_precision": 4, "filter_speckle": 8}, "clustering": {"eps": 0.4, "feature_weights": {"color": 3.0}}, "grouping": {"color_tolerance": 15.0},
    },
    "illustration": {"tracing": {"color_precision": 6}, "clustering": {"eps": 0.5}, "grouping": {"color_tolerance": 30.0}},
    "photograph": {
        "preprocessing": {"quantize_colors": True, "quantize_n_colors": 24}, "tracing": {"color_precision": 8}, "clustering": {"eps": 0.6}, "grouping": {"color_tolerance": 40.0},
    },
    "lineart": {
        "preprocessing": {"denoise": True, "denoise_strength": 7, "quantize_colors": True, "quantize_n_colors": 8},
        "tracing": {
            "mode": "spline", "color_precision": 8, "filter_speckle": 8, "corner_threshold": 25, "length_threshold": 15.0, "splice_threshold": 25, "path_precision": 12,
        },
        "optimization": {"simplify_paths": False, "merge_adjacent": False, "coordinate_precision": 4},
    },
}

# Profiles, which are given like files of settings.
PROFILES = {
    "smooth": {
        "preprocessing": {
            "quantize_colors": True, "quantize_mode": "adaptive", "quantize_n_colors": 24, "quantize_n_colors_min": 16, "quantize_n_colors_max": 64, "quantize_color_space": "lab",
        },
        "tracing": {
            "colormode": "color", "hierarchical": "stacked", "mode": "spline", "filter_speckle": 2, "color_precision": 12, "layer_difference": 16,
            "corner_threshold": 45, "length_threshold": 5.0, "splice_threshold": 45, "path_precision": 12,
        },
        "optimization": {"simplify_paths": False, "simplify_tolerance": 0.1, "coordinate_precision": 2, "merge_adjacent": False},
    },
    "portrait": {
        "preprocessing": {"enabled": True, "denoise": False, "denoise_strength": 5, "sharpen": False, "quantize_colors": False},
        "analysis": {"min_path_area": 0.5},
        "tracing": {
            "colormode": "color", "hierarchical": "stacked", "mode": "spline", "filter_speckle": 1, "color_precision": 14, "layer_difference": 8,
            "corner_threshold": 30, "length_threshold": 2.0, "splice_threshold": 25, "path_precision": 8,
        },
        "optimization": {"simplify_paths": False, "coordinate_precision": 2, "merge_adjacent": False},
    },
    "portrait_flat": {
        "preprocessing": {
            "enabled": True, "denoise": False, "quantize_colors": True, "quantize_mode": "adaptive", "quantize_n_colors": 24, "quantize_n_colors_min": 16,
            "quantize_n_colors_max": 32, "quantize_color_space": "lab",
        },
        "analysis": {"min_path_area": 0.5},
        "tracing": {
            "colormode": "color", "hierarchical": "stacked", "mode": "spline", "filter_speckle": 1, "color_precision": 14, "layer_difference": 8,
            "corner_threshold": 30, "length_threshold": 2.0, "splice_threshold": 25, "path_precision": 8,
        },
        "optimization": {"simplify_paths": False, "coordinate_precision": 2, "merge_adjacent": False},
    },
    "portrait_flat_compact": {
        "preprocessing": {
            "enabled": True, "denoise": False, "quantize_colors": True, "quantize_mode": "fixed", "quantize_n_colors_min": 30, "quantize_n_colors_max": 60,
            "quantize_n_colors": 50, "quantize_color_space": "lab",
        },
        "analysis": {"min_path_area": 4.0},
        "tracing": {
            "colormode": "color", "hierarchical": "stacked", "mode": "spline", "filter_speckle": 6, "color_precision": 12, "layer_difference": 12,
            "corner_threshold": 35, "length_threshold": 4.0, "splice_threshold": 35, "path_precision": 6,
        },
        "optimization": {"simplify_paths": True, "simplify_tolerance": 0.6, "coordinate_precision": 2, "merge_adjacent": True},
    },
}


def merged(base: dict, over: dict) -> dict:
    """base with the values of over; dicts merge key by key, anything else is replaced."""
    out = dict(base)
    for key, value in over.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = merged(out[key], value) if both else value
    return out


def load(settings: dict | None = None, path: str | None = None, preset: str | None = None) -> dict:
    """Defaults, then a preset (an unknown one changes nothing), a YAML file or named profile, and own settings."""
    out = merged(copy.deepcopy(DEFAULTS), PRESETS.get(preset or "", {}))
    if path in PROFILES:
        out = merged(out, PROFILES[path])
    elif path:
        import yaml

        with open(path, encoding="utf-8") as f:
            got = yaml.safe_load(f)
        if not isinstance(got, dict):
            raise ValueError(f"{path} holds no settings")
        out = merged(out, got)
    out = merged(out, settings or {})
    if out["hierarchy"]["area_ratio_threshold"] < 1:
        raise ValueError("hierarchy.area_ratio_threshold below 1 lets two boxes contain each other")
    return out
