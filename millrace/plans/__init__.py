"""Plan building: materialised intermediate tables, size-checked broadcasts, query registry."""
