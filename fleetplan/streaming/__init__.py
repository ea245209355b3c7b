"""Phase tracking, planning and history on streams."""
