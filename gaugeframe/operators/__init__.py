from .accuracy import AccuracyTarget, accuracy_attribute, accuracy_global, accuracy_value
from .completeness import (
    completeness_missing_attribute,
    completeness_missing_global,
    completeness_missing_value,
    row_completeness,
)
from .consistency import (
    association_consistency,
    consistency_attribute,
    consistency_value,
    parse_rule,
    rule_keys,
    rule_scores,
    rule_set,
    rule_table,
)
from .distinctness import (
    completeness_population,
    distinctness_attribute,
    distinctness_global,
    source_distinctness,
)
from .frequency import (
    frequency_attribute,
    frequency_global,
    frequency_groups,
    frequency_hour,
    frequency_value,
    hour_counts,
    update_rate_global,
    update_rate_values,
    value_hour_counts,
)
from .precision import precision_attribute, precision_global, precision_value
from .selection import (
    drop_incomplete,
    filter_intervals,
    filter_values,
    null_to_text,
    sample_by_key,
    sample_rows,
    select_columns,
    select_rows,
)
from .timeliness import (
    TimeColumn,
    timeliness_attribute,
    timeliness_global,
    timeliness_groups,
    timeliness_tuple,
    timeliness_value,
)
from .volume import total_rows, volume_global, volume_value

__all__ = [name for name in dir() if not name.startswith("_")]
