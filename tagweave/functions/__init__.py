"""Column functions: tags, filters, scores, detections, location tokens, geometry."""
