"""The whole analysis: events, clips, features, clusters, templates, scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.splitting import Calibration
from ..operators import clips, detect, features, scoring, spatial, splitting
from ..sources.folders import cut


@dataclass
class Sorted:
    edges: DataFrame
    events: DataFrame
    features: DataFrame
    labels: DataFrame
    neurons: DataFrame
    templates: DataFrame


def sort_events(samples: DataFrame, locations: DataFrame, calibration: Calibration, settings: Settings | None = None) -> Sorted:
    """What the steps make of ``samples`` (channel, t, x) and ``locations`` (channel, px, py). Features and labels are
    written to the checkpoint folder, the rest is lazy."""
    s = settings or Settings()
    edges = spatial.adjacency(locations, s.adjacency_radius)
    source = spatial.detection_channels(edges, s.detect_on)
    found = detect.local_extrema_blocks if s.critical_time_radius > 64 else detect.local_extrema
    events = found(samples, s.critical_time_radius).select(F.col("channel").alias("source"), "t").join(source, "source").select("channel", "t")
    # a channel's clip has all members of its patch, and only their samples are looked up
    members = spatial.patch_members(edges).select("channel", "member")
    wide = clips.extract_clips(samples, events, s.clip_size, members=members)
    patch = members.groupBy("channel").agg(F.count("*").alias("_members"))
    # members whose recording ends early leave gaps; such clips are left out
    vectors = clips.clip_vectors(wide).join(patch, "channel").filter(F.size("wave") == F.col("_members") * s.clip_size).drop("_members")
    # both are used several times
    feats = cut(features.pca_features(vectors, s.num_features))
    labels = cut(splitting.cluster_channels(feats, calibration, s.clusters, s.split_threshold, s.max_iterations, s.seed))
    neurons = clips.neuron_ids(labels)
    labelled = labels.join(neurons, ["channel", "label"]).select("neuron_id", "channel", "t")
    return Sorted(edges, events, feats, labels, neurons, clips.templates(samples, labelled, s.clip_size))


def score_all(samples: DataFrame, done: Sorted, settings: Settings | None = None) -> DataFrame:
    """(neuron_id, t, patch_score, full_score) of every neuron at every start."""
    size = (settings or Settings()).clip_size
    kernels = done.templates.withColumnRenamed("member", "channel")
    patches = spatial.neuron_patches(done.neurons, done.edges).withColumnRenamed("member", "channel")
    return scoring.gated_scores(samples, kernels, patches, size)
